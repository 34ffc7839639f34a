"""Packing by cutting-stock column generation.

Documents are cut into pieces of at most ``capacity`` tokens; piece lengths are counted in steps of ``quantum``. A
linear program over patterns (how many pieces of each length fill a sequence) is solved by column generation: an
unbounded-knapsack dynamic program prices new patterns with the dual values until none is better. Whole parts of the
solution are used as they are; what rounding leaves is packed by the largest piece and the fullest rest. Pieces of a length are ranked
over the corpus, and ranks tell pattern, copy and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.llm import tokens
from quotemill.llm.common import keep, rows


@dataclass(frozen=True)
class Packing:
    tokenizer: str | None = None
    end_id: int = 0
    capacity: int = 1024
    quantum: int = 4
    #: A document's last piece is cut once more where it is longer: few lengths above half a sequence find partners.
    longest_rest: int = 512
    #: The program ends when its bound shows that at most this part could still be gained, or after so many steps.
    gap: float = 0.0005
    most_steps: int = 4000
    #: Words that a worker remembers, documents that it takes and characters that it encodes at once.
    words: int = 300_000
    documents: int = 256
    characters: int = 1_000_000


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most value in the capacity, and how many of each size."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if n:
            worth = best[c - sizes[:n]] + value[:n]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], choice[c] = worth[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(best[capacity]), pattern


def fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The largest size that is left, with those that leave the least room in its sequence (bounded subset sums)."""
    pattern, top = np.zeros(len(sizes), np.int64), int(np.flatnonzero(left)[-1])
    room = capacity - int(sizes[top])
    pattern[top] = 1
    by = np.full(room + 1, -1)  # the size whose addition first reached a sum
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for k in range(len(sizes) - 1, -1, -1):
        size = int(sizes[k])
        for _ in range(min(int(left[k]) - (k == top), room // size)):
            new = np.flatnonzero(reached[: room + 1 - size] & ~reached[size:]) + size
            if not len(new):
                break
            reached[new], by[new] = True, k
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        pattern[by[at]] += 1
        at -= int(sizes[by[at]])
    return pattern


def solve(sizes: np.ndarray, demand: np.ndarray, p: Packing) -> list[tuple[int, np.ndarray]]:
    """(copies, pieces of each size): patterns that hold exactly the demand. sizes ascend."""
    capacity = p.capacity // p.quantum
    if not len(sizes):
        return []
    patterns = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    for _ in range(p.most_steps):
        dual = np.maximum(inverse.sum(0), 0)
        worth, column = best_pattern(sizes, dual, capacity)
        if worth <= 1 + p.gap:
            break
        way = inverse @ column
        able = way > 1e-9
        ratio = np.where(able, x / np.where(able, way, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        patterns[:, out] = column
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    found, left = [], demand.astype(np.int64).copy()
    for i in np.argsort(-x):
        pattern = patterns[:, i].astype(np.int64)
        with np.errstate(divide="ignore"):
            fits = int(np.where(pattern > 0, left // np.maximum(pattern, 1), np.iinfo(np.int64).max).min()) if pattern.any() else 0
        copies = min(int(x[i] + 1e-6), fits)
        if copies > 0:
            found.append((copies, pattern))
            left -= copies * pattern
    # the rest, at most some pieces for each pattern of the basis: the largest first, with what fills its sequence best
    rest: dict[bytes, int] = {}
    while left.any():
        pattern = fullest(sizes, left, capacity)
        copies = int(np.where(pattern > 0, left // np.maximum(pattern, 1), np.iinfo(np.int64).max).min())
        left -= copies * pattern
        rest[pattern.tobytes()] = rest.get(pattern.tobytes(), 0) + copies
    return found + [(n, np.frombuffer(b, np.int64)) for b, n in rest.items()]


def rank_table(sizes: np.ndarray, patterns: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: from which rank on a pattern holds it, the pattern's first sequence, and pieces in each copy."""
    out: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    given, sequence = np.zeros(len(sizes), np.int64), 0
    for copies, pattern in patterns:
        for k in np.flatnonzero(pattern):
            out[int(sizes[k])].append((int(given[k]), sequence, int(pattern[k])))
            given[k] += copies * pattern[k]
        sequence += copies
    return {s: tuple(np.array(x, np.int64).T) for s, x in out.items() if x}


PIECES = "part int, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, size bigint, nth bigint, ids binary"


def cuts(n: int, p: Packing) -> list[tuple[int, int]]:
    """Whole sequences, then what is left: one piece, or one of longest_rest and another."""
    full = n // p.capacity * p.capacity
    ends = [*range(p.capacity, full + 1, p.capacity), *([full + p.longest_rest] if n - full > p.longest_rest else []), *([n] if n > full else [])]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _pieces(p: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.drop_encoders()  # one of an earlier stage may remember more
        encoder, part, seen = tokens.Encoder(p.tokenizer or tokens.default_path(), p.words, p.characters), TaskContext.get().partitionId(), np.zeros(p.capacity + 1, np.int64)
        for batch in rows(batches, p.documents):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                data, n = np.append(ids, np.int32(p.end_id)).astype("<u4").tobytes(), len(ids) + 1
                for at, end in cuts(n, p):
                    piece = data[4 * at : 4 * end]
                    size = -(-(len(piece) // 4) // p.quantum)
                    out.append((part, doc_id, at, len(piece) // 4, zlib.crc32(piece), n, size, int(seen[size]), piece))
                    seen[size] += 1
            kinds = [pa.int32(), *[pa.int64()] * 7, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = table.value
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                first, base, each = where[int(s)]
                at = np.flatnonzero(size == s)
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = base[k] + (rank[at] - first[k]) // each[k]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence)], [*names, "sequence_id"])

    return run


def pack_documents(spark: SparkSession, docs: DataFrame, packing: Packing = Packing()) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) -> (pieces, ids).

    pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids: doc_id, start, ids (little-endian
    unsigned 32-bit integers), sequence_id is found by joining on doc_id and start.
    Null text: empty, so the end id alone. Repeated rows are packed each. An empty table gives empty results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = keep(spark, docs.mapInArrow(_pieces(packing), PIECES), "pieces")
    counts = keep(spark, pieces.groupBy("part", "size").agg(F.count("*").alias("n")), "counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "size", F.coalesce("before", F.lit(0)).alias("before"))
    demand = sorted((r["size"], r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect())  # a row for each length step
    sizes, wanted = np.array([s for s, _ in demand], np.int64), np.array([n for _, n in demand], np.int64)
    table = spark.sparkContext.broadcast(rank_table(sizes, solve(sizes, wanted, packing)))
    before = keep(spark, before, "before")
    ranked = pieces.drop("ids").join(before, ["part", "size"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("before") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(_place(table), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, size bigint, sequence_id bigint")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("size").desc(), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), pieces.select("doc_id", "start", "ids")
