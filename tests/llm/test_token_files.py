"""Token files and chunks: what workers hold, what is shuffled, and what comes back."""

from quotemill.llm import bpe_replay, huffman_tokens, tokens


class _Value:
    def __init__(self, value):
        self.value = value


def test_tasks_that_do_not_encode_drop_remembered_words():
    lengths = _Value(huffman_tokens.code_lengths(huffman_tokens.np.array([3, 2, 1])))
    for run in (huffman_tokens._encode(huffman_tokens.Format(), lengths, {}), huffman_tokens._decode(lengths, False)):
        tokens._ENCODERS["of an earlier stage"] = object()
        assert list(run(iter([]))) == [] and not tokens._ENCODERS


def test_digests_without_ids(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and some more {i}" * (i % 5)) for i in range(300)] + [(None, None)], "doc_id long, text string")
    fmt = huffman_tokens.Format(block_ids=40)
    whole = huffman_tokens.token_digests(spark, docs, fmt)
    bare = huffman_tokens.token_digests(spark, docs, fmt, with_ids=False)
    assert "ids" in whole.columns and "ids" not in bare.columns
    assert sorted(map(str, whole.drop("ids").collect())) == sorted(map(str, bare.collect()))


def test_documents_as_numbers_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"some words {i} and {i * i}" * (i % 4)) for i in range(200)], "doc_id long, text string")
    tables = {t.name for t in spark.catalog.listTables()}
    encoded = bpe_replay.encode_documents(spark, docs, chunk_chars=300)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk") + plan.count("Exchange hashpartitioning(of") == 1  # the answers
    assert {t.name for t in spark.catalog.listTables()} == tables
    of, _ = bpe_replay._spellings(bpe_replay.default_path())
    got = {r.doc_id: b"".join(of[i] for i in r.ids) for r in bpe_replay.id_lists(encoded).collect()}
    assert got == {r.doc_id: r.text.encode() for r in docs.collect()}
