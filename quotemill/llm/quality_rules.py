"""Quality rules: counts of words, symbols and repeats, and language-specific bands of n-gram perplexity.

The perplexity model (see kneser_ney) is one for all languages, as documents mix them; Spark counts the n-grams of all
documents. The model learns from those that have enough words and few symbols, so that what fills junk is unknown to
it. A second pass scores every document; each language's band is the median of its log perplexities with so many
robust deviations below and above, wider for documents of few words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import kneser_ney as kn
from quotemill.llm import tokens
from quotemill.llm.common import keep, row_key, rows

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: The model learns from documents with at most so many symbols for each word (and min_words).
    learn_symbols: float = 0.1
    #: Robust deviations below and above a language's median; few words widen the band.
    below: float = 8.0
    above: float = 8.0
    wide_words: float = 100.0
    #: Deviation, in log10 perplexity, that is taken at least.
    least_spread: float = 0.004
    #: Languages with fewer documents than this that pass the base rules use the band of all.
    least_documents: int = 30
    #: Models of up to so many n-grams (12 bytes each) are broadcast as sorted arrays; larger ones are joined.
    broadcast_grams: int = 8_000_000
    #: Distinct words that a task remembers.
    words: int = 300_000


GRAMS = "context bigint, d int, n bigint"
METRICS = "doc_id bigint, lang string, key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_p double, n_units bigint"


def _batch(context: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(context), pa.array(d.astype(np.int32)), pa.array(n)], ["context", "d", "n"])


def _count(r: Rules):
    """The n-grams of all texts, with how often learned texts hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.drop_encoders()
        words, times, edges = kn.Words(r.words), np.zeros(0, np.int64), []

        def out() -> Iterator[pa.RecordBatch]:
            names = list(words.numbers)
            for at in range(0, len(names), kn.PIECE):
                context, d, word, _ = kn.inner_grams(names[at : at + kn.PIECE])
                for x in kn.summed(context, d, times[at + word]):
                    yield _batch(*x)
            if edges:
                name, n = (np.concatenate(c) for c in zip(*edges, strict=True))
                name, at = np.unique(name, return_inverse=True)
                n = np.bincount(at, weights=n)
                for i in range(0, len(name), 1_000_000):
                    for x in kn.summed(*words.edge_grams(name[i : i + 1_000_000]), np.tile(n[i : i + 1_000_000], 2)):
                        yield _batch(*x)
            edges.clear()

        for batch in rows(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            split = [x.encode().split() for x in texts]
            x = words.of(split)
            words.new()
            learned = np.repeat([len(w) >= r.min_words and sum(map(t.count, SYMBOLS)) <= r.learn_symbols * len(w) for t, w in zip(texts, split, strict=True)], [len(w) for w in x])
            more = np.bincount(np.concatenate(x)[learned], minlength=len(words.numbers))
            more[: len(times)] += times
            times = more
            name, n = np.unique(words.edges(x) << 1 | learned, return_counts=True)
            edges.append((name >> 1, n * (name & 1)))
            if words.full or sum(len(e) for e, _ in edges) > 4_000_000:
                yield from out()
                words.clear()
                times = np.zeros(0, np.int64)
        yield from out()

    return run


def repeat_words(ids: np.ndarray, size: int = 3) -> int:
    """Words in windows of size words that are found twice or more, the first time included."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    key = ids[:n].copy()
    for i in range(1, size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i : n + i]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    marked = np.zeros(len(ids) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    marked[:n] += again
    marked[size:][:n] -= again
    return int((np.cumsum(marked) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _measure(r: Rules, model):
    """The base measures of every document, and its log probability where there is a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.drop_encoders()
        m: kn.Model | None = model.value if model else None
        words, inner, units, hashes = kn.Words(r.words), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known, value = np.zeros(0, np.int64), np.zeros(0)
        for batch in rows(batches):
            if words.full:
                words.clear()
                inner, units, hashes, known, value = inner[:0], units[:0], hashes[:0], known[:0], value[:0]
            texts = [x or "" for x in batch.column("text").to_pylist()]
            x = words.of([t.encode().split() for t in texts])
            had, new = len(hashes), words.new()
            hashes = np.concatenate([hashes, kn.mix64(np.arange(had + 1, had + len(new) + 1, dtype=np.uint64))])
            if m:
                a, b = m.inner(new)
                inner, units = np.concatenate([inner, a]), np.concatenate([units, b])
                name, place = np.unique(words.edges(x), return_inverse=True)
                fresh = np.setdiff1d(name, known, assume_unique=True)
                if len(fresh):
                    at = np.searchsorted(known, fresh)
                    known, value = np.insert(known, at, fresh), np.insert(value, at, m.look(*words.edge_grams(fresh)).reshape(2, -1).sum(0))
                edge = value[np.searchsorted(known, name)][place]
            out, end = [], 0
            for doc_id, lang, key, text, w in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "key")), texts, x, strict=True):
                end += len(w)
                log_p = float(inner[w].sum() + edge[end - len(w) : end].sum()) if m else None
                out.append((doc_id, lang, key, len(w), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines(text), repeat_words(hashes[w]), log_p, int(units[w].sum()) if m else None))
            names = [c.split()[0] for c in METRICS.split(", ")]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)

    return run


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's n-grams."""
    for batch in rows(batches, 64):
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = kn.Words(1)
            x = words.of([(text or "").encode().split()])
            if not len(x[0]):
                continue
            times = np.bincount(x[0])
            for at, piece in _pieces(words.new()):
                context, d, word, _ = kn.inner_grams(piece)
                for part in kn.summed(context, d, times[at + word]):
                    yield _keyed(key, *part)
            edges, n = np.unique(words.edges(x), return_counts=True)
            for part in kn.summed(*words.edge_grams(edges), np.tile(n, 2)):
                yield _keyed(key, *part)


def _pieces(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(words), kn.PIECE):
        yield at, words[at : at + kn.PIECE]


def _keyed(key: int, context: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), key, np.int64)), pa.array(context), pa.array(d.astype(np.int32)), pa.array(n)], ["key", "context", "d", "n"])


def scored_by_join(docs: DataFrame, logs: DataFrame) -> DataFrame:
    """docs(key, text), logs(context, d, log_p) -> key, log_p, n_units: each document's n-grams meet the model in a join."""
    grams = docs.dropDuplicates(["key"]).select("key", "text").mapInArrow(_grams_of, "key bigint, " + GRAMS)
    return grams.join(logs, ["context", "d"]).groupBy("key").agg(F.sum(F.col("n") * F.col("log_p")).alias("log_p"), F.sum("n").alias("n_units"))


def measures(spark: SparkSession, docs: DataFrame, r: Rules) -> DataFrame:
    """The base measures and the log probability of every row of docs(doc_id, text, lang, key)."""
    counts = keep(spark, docs.select("text").mapInArrow(_count(r), GRAMS).groupBy("context", "d").agg(F.sum("n").alias("n")), "counts")
    logs = keep(spark, kn.log_probabilities(spark, counts), "logs")
    if logs.count() <= r.broadcast_grams:
        model = spark.sparkContext.broadcast(kn.sorted_arrays(logs.toArrow()))
        return keep(spark, docs.mapInArrow(_measure(r, model), METRICS), "metrics")
    base = docs.mapInArrow(_measure(r, None), METRICS).drop("log_p", "n_units")
    return keep(spark, base.join(scored_by_join(docs, logs), "key", "left"), "metrics")


def quality_rules(spark: SparkSession, docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, log_ppl, low, high; one row for each input row.

    Null or empty text: no words, so base_failed. Null lang: a language of its own. Repeated rows each get a row; a null
    doc_id stays null. An empty table gives an empty result; more columns are ignored. A document without words has a
    null log_ppl. Where no document can be learned from, all have the same perplexity and the band keeps them.
    """
    r = rules
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("key", row_key())
    measured = measures(spark, docs, r).withColumn("base_failed", (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words"))).withColumn("log_ppl", -F.col("log_p") / F.expr("nullif(n_units, 0)"))
    quarters = [F.count("*").alias("docs"), F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000).alias("q")]
    sound = measured.where(~F.col("base_failed"))
    overall = sound.agg(*quarters).first()
    middle = overall["q"] or [0.0, 0.0, 0.0]
    bands = sound.groupBy(F.coalesce("lang", F.lit("")).alias("of_lang")).agg(*quarters).where(F.col("docs") >= r.least_documents)
    own = measured.join(bands, F.coalesce("lang", F.lit("")) == F.col("of_lang"), "left")
    q = [F.coalesce(F.col("q")[i], F.lit(float(middle[i]))) for i in range(3)]
    spread = F.greatest((q[2] - q[0]) / 1.349, F.lit(r.least_spread)) * F.sqrt(1 + r.wide_words / F.greatest("n_words", F.lit(1)))
    out = own.withColumn("low", q[1] - r.below * spread).withColumn("high", q[1] + r.above * spread)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high")
