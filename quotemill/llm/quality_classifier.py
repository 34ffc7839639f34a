"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from the shapes of its words (shares of
capitals, symbols, digits, lengths, hashed endings) and from its repetition; a dense layer, gated attention weights
over the passages of a document and a logistic layer on the weighted sum are learned from document labels alone, in
numpy, on a bounded sample of labelled documents (FIT_DOCUMENTS, by hash of doc_id).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import crc_mod, mix64, rows

PASSAGE = 64
SHAPE, HASHED = 12, 8
#: Mean and spread of the word features, and four of the passage.
WIDE = 2 * SHAPE + HASHED + 4


@dataclass(frozen=True)
class Settings:
    fold: int = 5
    held_out: int = 0
    fit_documents: int = 6000
    hidden: int = 24
    gate: int = 12
    epochs: int = 20
    batch: int = 64
    rate: float = 0.01
    threshold: float = 0.3
    words: int = 600_000


def word_features(words: list[bytes]) -> np.ndarray:
    """Of each word: shape numbers, and signs from the hash of its last three bytes."""
    flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    end = np.flatnonzero(flat == 10)
    owner = np.cumsum(flat == 10) - (flat == 10)
    size = np.maximum(np.diff(end, prepend=-1) - 1, 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=len(words)) / size

    upper = (flat >= 65) & (flat <= 90)
    digit = (flat >= 48) & (flat <= 57)
    lower = (flat >= 97) & (flat <= 122)
    high = flat >= 128
    mark = (flat == 33) | (flat == 63)
    stop = (flat == 46) | (flat == 44)
    other = ~(upper | digit | lower | high | mark | stop | (flat == 10))
    last, first = flat[end - 1], flat[np.concatenate([[0], end[:-1] + 1])]
    shape = np.stack([share(upper), share(digit), share(lower), share(high), share(mark), share(stop), share(other), np.minimum(size, 20) / 10, size == 1, (first >= 65) & (first <= 90), (last == 46) | (last == 44), other[end - 1]], 1)
    code = np.zeros(len(words), np.uint64)
    for back in (1, 2, 3):
        code = code * np.uint64(257) + np.where(size >= back, flat[np.maximum(end - back, 0)], 0).astype(np.uint64)
    bits = mix64(code[:, None] * np.uint64(HASHED) + np.arange(HASHED, dtype=np.uint64)) & np.uint64(1)
    return np.concatenate([shape, bits.astype(float) - 0.5], 1).astype(np.float32)


class Passages:
    """Encodes the passages of texts; remembers the features of the words that it has met."""

    def __init__(self, limit: int):
        self.limit = limit
        self.numbers, self.features = defaultdict(count().__next__), np.zeros((0, SHAPE + HASHED), np.float32)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all passages (a text without words has one of zeros), and passages of each text."""
        if len(self.numbers) > self.limit:
            self.numbers, self.features = defaultdict(count().__next__), np.zeros((0, SHAPE + HASHED), np.float32)
        x = [np.fromiter(map(self.numbers.__getitem__, w), np.int64, len(w)) for w in ((t or b"").split() for t in texts)]
        if len(self.numbers) > len(self.features):
            self.features = np.concatenate([self.features, word_features(list(islice(self.numbers, len(self.features), None)))])
        n = np.array([max(1, -(-len(w) // PASSAGE)) for w in x])
        out = np.zeros((int(n.sum()), WIDE), np.float32)
        flat = np.concatenate(x)
        if len(flat):
            length = np.array([len(w) for w in x])
            at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            passage = np.repeat(np.cumsum(n) - n, length) + at // PASSAGE
            start = np.flatnonzero(np.diff(passage, prepend=-1))
            size = np.diff(np.append(start, len(flat))).astype(np.float32)
            which = passage[start]
            f = self.features[flat]
            mean = np.add.reduceat(f, start) / size[:, None]
            square = np.add.reduceat(f[:, :SHAPE] ** 2, start) / size[:, None]
            out[which, : SHAPE + HASHED] = mean
            out[which, SHAPE + HASHED : 2 * SHAPE + HASHED] = np.sqrt(np.maximum(square - mean[:, :SHAPE] ** 2, 0))
            order = np.lexsort((flat, passage))
            fresh = np.ones(len(flat), bool)
            fresh[1:] = (flat[order][1:] != flat[order][:-1]) | (passage[order][1:] != passage[order][:-1])
            again = np.concatenate([[False], (flat[1:] == flat[:-1]) & (passage[1:] == passage[:-1])])
            out[which, -4] = np.bincount(passage[order], weights=fresh, minlength=len(out))[which] / size
            out[which, -3] = np.bincount(passage, weights=again, minlength=len(out))[which] / size
            out[which, -2] = size / PASSAGE
            out[:, -1] = np.repeat(np.log1p(length) / 10, n)
        return out, n


def start(s: Settings, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"mean": (WIDE,), "scale": (WIDE,), "dense": (WIDE, s.hidden), "dense_bias": (s.hidden,), "v": (s.hidden, s.gate), "u": (s.hidden, s.gate), "w": (s.gate,), "out": (s.hidden,), "bias": (1,)}
    return {k: (rng.standard_normal(v) / np.sqrt(v[0])).astype(np.float32) for k, v in shapes.items()}


def forward(p: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The score of each document, from the vectors of its passages."""
    x = (x - p["mean"]) / p["scale"]
    h = np.tanh(x @ p["dense"] + p["dense_bias"])
    tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = np.exp(np.clip((tv * su) @ p["w"], -30, 30))
    first, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    a = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    y = 1 / (1 + np.exp(-np.clip(z @ p["out"] + p["bias"], -30, 30)))
    return y, (x, h, tv, su, a, z, owner, first)


def gradient(p: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    y, (x, h, tv, su, a, z, owner, first) = forward(p, x, n)
    dy = (y - label) / len(label)
    g = {"out": z.T @ dy, "bias": dy.sum(keepdims=True)}
    dz = np.outer(dy, p["out"])
    da = (h * dz[owner]).sum(1)
    dh = a[:, None] * dz[owner]
    de = a * (da - np.add.reduceat(a * da, first)[owner])
    g["w"] = (tv * su).T @ de
    dt = np.outer(de, p["w"])
    dtv, dsu = dt * su * (1 - tv**2), dt * tv * su * (1 - su)
    g["v"], g["u"] = h.T @ dtv, h.T @ dsu
    dh += dtv @ p["v"].T + dsu @ p["u"].T
    dx = dh * (1 - h**2)
    g["dense"], g["dense_bias"] = x.T @ dx, dx.sum(0)
    return g


def fit(bags: list[np.ndarray], labels: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    p = start(s)
    if not bags:
        p["out"][:] = 0
        p["bias"][:] = 0
        p["mean"][:], p["scale"][:] = 0, 1
        return p
    everything = np.concatenate(bags)
    p["mean"], p["scale"] = everything.mean(0), everything.std(0) + 0.01
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    rng, t, total = np.random.default_rng(1), 0, s.epochs * -(-len(bags) // s.batch)
    for _ in range(s.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), s.batch):
            i, t = order[at : at + s.batch], t + 1
            for k, g in gradient(p, np.concatenate([bags[b] for b in i]), np.array([len(bags[b]) for b in i]), labels[i]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g**2 - v[k])
                p[k] = (p[k] - s.rate * (1 - t / (total + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return p


def _encode(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(s.words)
        for batch in rows(batches, 256):
            x, n = passages.of(batch.column("text").to_pylist())
            blobs = [part.tobytes() for part in np.split(x, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["doc_id", "label", "bag"])

    return run


def _score(s: Settings, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, p = Passages(s.words), model.value
        for batch in rows(batches, 256):
            x, n = passages.of(batch.column("text").to_pylist())
            y = forward(p, x, n)[0].astype(float) if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(y), pa.array((y >= s.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, held_out, score, predicted; a row for each row of docs.

    Labels are learned from where the row is not held out; a document with several labels has their mean, from 0.5
    on taken as 1. Null or empty text: one passage of zeros. Without labels every score is 0.5. Rows of docs that are
    there twice each get a row; more columns are ignored.
    """
    s = settings
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(crc_mod("doc_id", s.fold) == s.held_out, F.lit(False)).alias("held_out"))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(crc_mod("doc_id", s.fold) != s.held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(s.fit_documents)
    bags = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(_encode(s), "doc_id bigint, label double, bag binary")  # at most fit_documents rows
    got = bags.orderBy("doc_id", "bag").collect()
    p = fit([np.frombuffer(r["bag"], np.float32).reshape(-1, WIDE) for r in got], np.array([r["label"] for r in got]), s)
    return docs.mapInArrow(_score(s, spark.sparkContext.broadcast(p)), "doc_id bigint, held_out boolean, score double, predicted int")
