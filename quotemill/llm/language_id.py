"""Language ID: averaged hashed subword embeddings with a linear softmax, trained in numpy, with calibrated rejection.

Subwords are the words and their 2- to 4-character pieces, with marks at the ends, in hash buckets. The model is
fitted on a bounded number of documents of each language (fit_documents, by hash of doc_id) and on short stretches of them, so that
short texts are met in training too. A part of the sample calibrates the temperature and the rejection threshold.
For scoring, embedding and softmax weights fold into one table of bucket scores, and each distinct word keeps its sum.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.llm.common import POLY, crc_mod, mix64, rows
from quotemill.llm.kneser_ney import spelled

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    fold: int = 3
    held_out: int = 1
    #: Documents of each language that the model is fitted on, at most, and words of the short stretch of each.
    fit_documents: int = 700
    stretch: int = 12
    bucket_bits: int = 15
    dim: int = 16
    epochs: int = 6
    rate: float = 0.5
    #: A calibration document in so many; rejected: below the threshold that keeps this share of them.
    calibrate: int = 5
    keep_share: float = 0.99
    words: int = 600_000


def subwords(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words, and which word each belongs to."""
    chars, start, stop = spelled(words)
    word = np.repeat(np.arange(len(words)), stop - start + 1)
    place = np.arange(len(chars)) - start[word]
    c = chars.astype(np.uint64) + np.uint64(1)
    buckets, owners = [], []
    for n in (2, 3, 4):
        h = np.zeros(len(c), np.uint64)
        for i in range(n):
            h = h * np.uint64(POLY) + np.roll(c, n - 1 - i)
        at = np.flatnonzero(place >= n - 1)
        buckets.append(mix64(h[at] + np.uint64(n)) >> np.uint64(64 - bits))
        owners.append(word[at])
    end = np.flatnonzero(np.diff(word, append=-1))
    whole = np.add.reduceat(mix64(c + place.astype(np.uint64) * np.uint64(POLY)), np.flatnonzero(place == 0))
    buckets.append(mix64(whole) >> np.uint64(64 - bits))
    owners.append(word[end])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _features(s: Settings):
    """For each document two rows: the buckets with their shares of the whole text, and of a short stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 64):
            out = []
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                words = words_of(text)
                at = (doc_id or 0) * 7919 % max(1, len(words) - s.stretch)
                for kind, part in enumerate((words, words[at : at + s.stretch])):
                    if part:
                        b, n = np.unique(subwords(part, s.bucket_bits)[0], return_counts=True)
                        out.append((doc_id, kind, lang, b.astype(np.int32).tobytes(), (n / n.sum()).astype(np.float32).tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "kind", "lang", "buckets", "shares"])

    return run


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket -> score of each language
    bias: np.ndarray
    temperature: float
    threshold: float


def fit(samples: list[tuple[np.ndarray, np.ndarray, str, bool]], s: Settings) -> Model:
    """samples: (buckets, shares, language, is for calibration)."""
    languages = sorted({x[2] for x in samples})
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(5)
    embed = (rng.standard_normal((1 << s.bucket_bits, s.dim)) / s.dim).astype(np.float32)
    weight, bias = np.zeros((s.dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    learn = [x for x in samples if not x[3]] or samples
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for i in rng.permutation(len(learn)):
            b, share, lang, _ = learn[i]
            rows_ = embed[b]
            mean = share @ rows_
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[lang]] -= 1
            back = weight @ p
            weight -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            embed[b] = rows_ - rate * 20 * np.outer(share, back)
    table = embed @ weight
    test = [x for x in samples if x[3]] or samples
    scores = np.array([x[1] @ table[x[0]] + bias for x in test]).reshape(-1, max(1, len(languages)))
    right = np.array([number[x[2]] for x in test])

    def probabilities(t: float) -> np.ndarray:
        z = scores / t
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    temperature = min((0.25 * 1.1**k for k in range(40)), key=lambda t: -np.log(probabilities(t)[np.arange(len(right)), right] + 1e-12).sum()) if len(test) else 1.0
    sure = np.sort(probabilities(temperature).max(1)) if len(test) else np.zeros(1)
    return Model(languages, table, bias, temperature, float(sure[int((1 - s.keep_share) * len(sure))]))


def _predict(s: Settings, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        numbers, sums, sizes = defaultdict(count().__next__), np.zeros((0, len(m.languages))), np.zeros(0)
        for batch in rows(batches):
            if len(numbers) > s.words:
                numbers, sums, sizes = defaultdict(count().__next__), np.zeros((0, len(m.languages))), np.zeros(0)
            texts = batch.column("text").to_pylist()
            x = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts if m.languages else [None] * len(texts))]
            if len(numbers) > len(sums):
                new = list(islice(numbers, len(sums), None))
                b, owner = subwords(new, s.bucket_bits)
                sums = np.concatenate([sums, np.stack([np.bincount(owner, weights=m.table[b, k], minlength=len(new)) for k in range(len(m.languages))], 1)])
                sizes = np.concatenate([sizes, np.bincount(owner, minlength=len(new))])
            out = []
            for text, w in zip(texts, x, strict=True):
                if not m.languages or not any(map(str.isalpha, text or "")):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                z = (sums[w].sum(0) / max(1.0, sizes[w].sum()) + m.bias) / m.temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                k = int(p.argmax())
                out.append((m.languages[k], float(p[k]), bool(p[k] < m.threshold)))
            kinds = [pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def train(docs: DataFrame, s: Settings) -> Model:
    """From text and lang of documents that are not held out: of each language a bounded number, the first by hash of
    doc_id. A hash leaves about twice as many of a language in before they are ranked."""
    known = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("draw", F.xxhash64("doc_id", F.lit(11)))
    sizes = known.groupBy("lang").agg(F.greatest(F.lit(1), F.expr(f"count(*) div {2 * s.fit_documents}")).alias("one_in"))
    drawn = known.join(sizes, "lang").where(F.pmod("draw", "one_in") == 0)
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text")))
    sample = ranked.where(F.col("k") <= s.fit_documents)
    got = sample.select("doc_id", "text", "lang").mapInArrow(_features(s), "doc_id bigint, kind int, lang string, buckets binary, shares binary").orderBy("doc_id", "lang", "kind", "buckets").collect()
    return fit([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), r["lang"], (r["doc_id"] or 0) % s.calibrate == 0) for r in got], s)


def identify_language(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score, rejected; one row for each input row.

    Null text or text without a letter: ``und``, score 0, rejected. rejected marks scores below the calibrated
    threshold; the best language is given all the same. Null lang is not learned from. Without rows to learn from
    all is ``und``. Repeated rows each get a row; more columns are ignored.
    """
    s = settings
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(crc_mod("doc_id", s.fold) == s.held_out, F.lit(False)).alias("held_out"))
    model = spark.sparkContext.broadcast(train(docs, s))
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(s, model), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
