"""Token ids of whole texts with the tokenizers library, remembered by word.

The byte-level pre-tokenizer never joins a character that is not white space with white space after it, so a text's
ids are those of its pieces (white space, then a word), joined. Each distinct piece is encoded once for each worker.
Texts with other white space than ASCII's are encoded whole.

As the tokenizer files' description has it, a special token's string in a text is ordinary text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Characters of texts that are split at once.
AT_ONCE = 4_000_000
#: White space that is not one of the six ASCII characters, or that libraries disagree on.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: In texts without these, each space begins a piece of its own.
NOT_PLAIN = "  | [\t-\r]| $|[\x1c-\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200d}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"


def _other_space(text: str) -> bool:
    """Whether a text has white space other than ASCII's six characters."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else bool(OTHER_SPACE.search(text))


def keys_of(text: str) -> list[str]:
    """The pieces of a text, by the names under which they are remembered: a word for a space and that word, and
    anything else with a space behind it (no word has one)."""
    return [p[1:] if p[0] == " " and len(p) > 1 and " " not in p[1:] else p + " " for p in PIECE.findall(text)]


class Encoder:
    """Encodes texts, so many characters at once; the pieces that it remembers are cleared when they reach the limit."""

    def __init__(self, path: str, limit: int = 1_000_000, at_once: int = AT_ONCE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # in a byte-level vocabulary each character stands for a byte
            self.widths[i] = len(token)
        self.stops = {c: vocabulary[c] for c in ".,"}
        self.limit, self.at_once = limit, at_once
        self.clear()

    def clear(self) -> None:
        self.numbers = defaultdict(count().__next__)
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.encoded = 0
        self.used = 0

    def _store(self, numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used += len(flat)

    def _encode_new(self) -> None:
        """Encodes the pieces that have a number but no ids yet.

        A full stop or comma after a letter is a token of its own, so such a piece is its word's ids and one more. Other
        words are joined into strings of many, which encode faster; the number of bytes that each id stands for tells
        where a piece ends.
        """
        new = list(islice(self.numbers, self.encoded, None))
        if not new:
            return
        ended = [i for i, p in enumerate(new) if p[-1:] in self.stops and p[-2:-1].isalpha()]
        words = np.fromiter((self.numbers[new[i][:-1]] for i in ended), np.int64, len(ended))
        new += islice(self.numbers, self.encoded + len(new), None)
        while len(self.numbers) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        skip = np.zeros(len(new), bool)
        skip[ended] = True
        plain, rest = [], []
        for i in np.flatnonzero(~skip).tolist():
            p = new[i]
            (plain if p[:1] > " " and p[-1] > " " else rest).append(i)
        joined = ["".join([" " + new[i] for i in plain[at : at + 100]]) for at in range(0, len(plain), 100)]
        if any(map(_other_space, joined)):
            rest += [i for i in plain if OTHER_SPACE.search(new[i])]
            plain = [i for i in plain if not OTHER_SPACE.search(new[i])]
            joined = ["".join([" " + new[i] for i in plain[at : at + 100]]) for at in range(0, len(plain), 100)]
        alone = [new[i][:-1] if new[i][-1:] == " " else " " + new[i] for i in rest]
        found = self.tokenizer.encode_batch_fast(joined + alone, add_special_tokens=False)
        ids = [np.array(x.ids, np.int32) for x in found]
        if ids:
            flat = np.concatenate(ids)
            spaces = np.flatnonzero(np.frombuffer("".join(joined).encode() + b" ", np.uint8) == 32)
            n_joined = sum(map(len, ids[: len(joined)]))
            last = np.searchsorted(np.cumsum(self.widths[flat[:n_joined]]), spaces[1:]) + 1
            sizes = np.concatenate([np.diff(last, prepend=0), np.array([len(x) for x in ids[len(joined) :]], np.int64)])
            self._store(self.encoded + np.array(plain + rest, np.int64), flat, sizes)
        if ended:
            flat, sizes = self._gather(words)
            stop = np.fromiter((self.stops[new[i][-1]] for i in ended), np.int32, len(ended))
            self._store(self.encoded + np.array(ended, np.int64), np.insert(flat, np.cumsum(sizes), stop), sizes + 1)
        self.encoded = len(self.numbers)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered pieces, behind each other, and the number of each."""
        size = self.sizes[numbers].astype(np.int64)
        stop = np.cumsum(size)
        return self.ids[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.starts[numbers] - (stop - size), size)], size

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that each have a space before them, behind each other, and the number of each."""
        if len(self.numbers) > self.limit:
            self.clear()
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._encode_new()
        return self._gather(numbers)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """An array of int32 ids for each text."""
        out, at, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > self.at_once or i == len(texts) - 1:
                out += self._encode_some(texts[at : i + 1])
                at, size = i + 1, 0
        return out

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        """Arrow splits plain texts and finds their different words, so that Python looks each of these up once."""
        if len(self.numbers) > self.limit:
            self.clear()
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, NOT_PLAIN).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        words = split.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.numbers.__getitem__, known), np.int64, len(known))
        flat, ends = numbers[words.indices.to_numpy()], split.offsets.to_numpy()
        for at in ends[:-1].tolist():  # no space stands before a text's first word
            flat[at] = self.numbers[known[words.indices[at].as_py()] + " "]
        whole = {i for i in np.flatnonzero(odd).tolist() if _other_space(texts[i])}
        others = {i: np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys)) for i, keys in ((i, keys_of(texts[i])) for i in np.flatnonzero(odd).tolist() if i not in whole)}
        self._encode_new()
        ids, size = self._gather(flat)
        bounds = np.concatenate([[0], np.cumsum(size)])[ends]
        plain = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        out = []
        for i, text in enumerate(texts):
            if i in whole:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32))
            elif odd[i]:
                out.append(self._gather(others[i])[0])
            else:
                a, b = next(plain)
                out.append(ids[a:b])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: what it remembers serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def drop_encoders() -> None:
    """Tasks that don't encode call this, so that a reused worker doesn't hold an earlier stage's pieces."""
    _ENCODERS.clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
