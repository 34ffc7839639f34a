"""The encoder that remembers words against the tokenizer, freshly loaded, on whole texts."""

import random

from tokenizers import Tokenizer

from quotemill.llm.tokens import Encoder, default_path

ATOMS = [" ", "  ", "\n", " \n", "\n ", "\t", "\r\n", "a", "foo", "Bar.", "x,", "1.", "é", "ß.", ".", " .", "..", "don't", "日本", "\xa0", "\u3000", "\x1c", "<|endoftext|>", "it's.", "  \n\n", "\x0b", "$$$", "\x00", " \x00"]


def test_encoder_equals_the_tokenizer():
    fresh = Tokenizer.from_file(default_path())
    fresh.encode_special_tokens = True
    r, encoder = random.Random(1), Encoder(default_path(), limit=2000)
    texts = ["".join(r.choices(ATOMS, k=r.randint(0, 14))) for _ in range(8000)] + ["", " ", "\n", "word " * 50_000, "x" * 100_000]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [x.tolist() for x in encoder.encode(part)] == [x.ids for x in fresh.encode_batch(part, add_special_tokens=False)]
    words = ["foo", "a\xa0b", "x.", "日本,", "foo"]
    ids, sizes = encoder.encode_words(words)
    assert ids.tolist() == [i for w in words for i in fresh.encode(" " + w, add_special_tokens=False).ids] and sizes.sum() == len(ids)
