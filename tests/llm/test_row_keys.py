"""Rows without a doc_id, and rows that share one, in the near-duplicate and benchmark stages of the pipeline."""

from collections import Counter

import corpus_pipeline
from test_llm_operators import words

from quotemill.llm import jaccard_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def near(text, k):
    w = text.split()
    w[k] = "changed"
    return " ".join(w)


TEXTS = [" ".join(words(150, 300 + i)) for i in range(8)]
A, B, C, D, E, F, G, H = TEXTS


def test_near_duplicates_without_or_with_shared_ids(spark):
    rows = [(None, A), (None, B), (None, near(B, 40)), (1, C), (None, near(C, 50)), (7, D), (7, near(D, 60)), (7, E), (8, E), (9, F), (9, G), (None, H), (None, H)]
    docs = table(spark, rows)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert set(got.values()) == {1}
    b, d = ([x for x in got if x[1] in (t, near(t, k))] for t, k in ((B, 40), (D, 60)))
    assert len(b) == 1 and b[0][0] is None and len(d) == 1 and d[0][0] == 7  # copies that share an id, or have none, leave one
    assert set(got) == {(None, A), b[0], (1, C), d[0], (7, E), (9, F), (9, G), (None, H)}
    out = jaccard_join.jaccard_components(spark, docs).collect()
    assert len(out) == len(rows) and Counter((r["doc_id"], r["component_id"]) for r in out)[(None, 1)] == 1


def test_benchmark_free_judges_each_row(spark, tmp_path):
    item = " ".join(words(40, 400))
    held = A + " " + item
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, [(None, held), (None, B), (3, held + " " + C), (3, D), (4, E), (5, None)])
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_free(spark, docs, str(tmp_path)).collect())
    assert got == Counter([(None, B), (3, D), (4, E), (5, None)])


def test_pipeline_keeps_clean_rows_without_an_id(spark, tmp_path):
    item = " ".join(words(40, 401))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [" ".join(f"{w}{i * k % 97}" for k, w in enumerate(words(90, 500 + i))) for i in range(3)]
    table(spark, [(None, clean[0]), (None, clean[0] + " " + item), (2, clean[1]), (2, clean[1] + " end"), (2, clean[2] + " " + item)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r["doc_id"] for r in got.where("start = 0").collect()) == Counter([None, 2])
