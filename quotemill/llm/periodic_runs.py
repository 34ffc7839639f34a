"""Periodic runs of words in whole documents, by tiles for each octave of periods.

A run is a maximal stretch of words with smallest period q and a length of at least max(24, 3 q). Position i matches at
period q if words i and i + q are identical, so a run is a maximal interval of positions that match.

1. Each octave of periods [P, 2 P) has its tiles: parts of a document that overlap by a few P. Only parts that can hold a
   run become tiles: where every word comes again within 2 P words, for as long as a run's matches are.
2. Tiles are dealt to tasks and solved alone. At each boundary, every max(P, 8) words, Z-functions give for all periods
   of the octave how far the words match to the right and to the left; matches that fill a step become fragments.
3. Fragments meet by document and period and are stitched where they touch. Stretches with the same ends have the same
   smallest period, so the smallest stays.

A tile of an octave is a bounded number of its periods long, so the share of one task grows with the longest period only.
Null and empty texts have no words; a null doc_id plants nothing in op12. Rows are known by a hash of doc_id and text:
each row of a table gets its row, also where rows are there twice. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.llm.common import keep, row_key, rows

SHORTEST, TIMES = 24, 3
#: Boundaries of a tile.
BOUNDARIES = 16

Change = Callable[[int | None, list[bytes]], list[bytes]]
RUN = "struct<start:long,length:long,period:long>"


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """op12's words: in one document of ten, by crc32 of its decimal doc_id, the words from a on repeat with period p."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def unchanged(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def z_function(x: list[int]) -> list[int]:
    """For each position the length of the longest common prefix of x and x from there on."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def step_of(octave: int) -> int:
    return max(1 << octave, 8)


def least_matches(octave: int) -> int:
    """The fewest matching positions of a run with a period of this octave."""
    return max(SHORTEST - (2 << octave) + 1, (TIMES - 1) << octave)


def solve(tile: list[int], octave: int, first: int, boundaries: int, cut: int) -> list[tuple[int, int, int]]:
    """(period, from, to): intervals of matching positions in a tile, joined where they touch.

    Boundaries lie at first, first + step, ...; positions from ``cut`` on belong to no tile of this octave. An interval
    is followed from a boundary at which a whole step matches, one step to the left and two to the right: further on the
    next boundary has it.
    """
    low, step = 1 << octave, step_of(octave)
    open_at: dict[int, tuple[int, int]] = {}
    out = []
    for c in range(first, min(first + boundaries * step, cut), step):
        right = tile[c : c + 2 * low + 2 * step]
        z = z_function(right)
        found = [(q, min(z[q], 2 * step)) for q in range(low, min(2 * low, len(z))) if z[q] >= step]
        if not found:
            continue
        head = tile[max(0, c - step) : c][::-1]
        back = z_function([*head, -1, *tile[max(0, c - step) : c + 2 * low][::-1]])
        end = min(len(tile), c + 2 * low)
        for q, ahead in found:
            behind = back[len(head) + 1 + (end - (c + q))] if c + q <= end and head else 0
            a, b = c - behind, c + ahead
            if q in open_at and open_at[q][1] >= a:
                open_at[q] = (open_at[q][0], max(b, open_at[q][1]))
            else:
                if q in open_at:
                    out.append((q, *open_at[q]))
                open_at[q] = (a, b)
    return out + [(q, a, b) for q, (a, b) in open_at.items()]


def _word_numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words of some documents as numbers, and how far on the same document has each word again (or never: a large number)."""
    known = defaultdict(count().__next__)
    flat = np.concatenate([np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in texts] + [np.zeros(0, np.int64)])
    of = np.repeat(np.arange(len(texts), dtype=np.int64), [len(w) for w in texts])
    key = of * max(len(known), 1) + flat
    order = np.argsort(key, kind="stable")
    again = np.full(len(flat), np.iinfo(np.int64).max)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    again[order[same]] = order[same + 1] - order[same]
    return flat, again


def _tiles(lengths: list[int], again: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, octave, tile's first word, its end, first boundary in the document, cut), for each tile that can hold a run."""
    starts = np.cumsum([0, *lengths])
    longest, octave = max(lengths, default=0), 0
    while TIMES << octave <= longest:
        low, step, least = 1 << octave, step_of(octave), least_matches(octave)
        near = np.concatenate([[0], (again < 2 * low).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(near))
        for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1)[:, 0] >= least].tolist():
            doc = int(np.searchsorted(starts, a, side="right")) - 1
            base, n = int(starts[doc]), lengths[doc]
            a, b = a - base, b - base  # matching positions; no document's last word has another behind it
            for at in range(a, b, BOUNDARIES * step):
                yield doc, octave, max(a, at - step), min(n, b + 2 * low, at + BOUNDARIES * step + 2 * low + 2 * step), at, b
        octave += 1


def _first_pass(change: Change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 128):
            doc_ids, rids = batch["doc_id"].to_pylist(), batch["rid"].to_pylist()
            texts = [change(i, (t or "").encode().split()) for i, t in zip(doc_ids, batch["text"].to_pylist(), strict=True)]
            flat, again = _word_numbers(texts)
            lengths = [len(w) for w in texts]
            starts = np.cumsum([0, *lengths])
            tiles = list(_tiles(lengths, again))
            tiled = {t[0] for t in tiles}
            joined = [b" ".join(w) for w in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["rid"], batch["doc_id"], pa.array([None if i in tiled else hashlib.sha256(x).hexdigest() for i, x in enumerate(joined)], pa.string()), pa.array([x if i in tiled else None for i, x in enumerate(joined)], pa.binary()), *(pa.nulls(len(texts), kind) for kind in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["rid", "doc_id", "sha", "words", "octave", "start", "first", "cut", "tile"],
            )
            for at in range(0, len(tiles), 256):
                some = tiles[at : at + 256]
                blobs = [flat[starts[d] + a : starts[d] + b].astype("<i4").tobytes() for d, _, a, b, _, _ in some]
                columns = [pa.array([rids[t[0]] for t in some], pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.binary()), pa.array([t[1] for t in some], pa.int32()), *(pa.array([t[k] for t in some], pa.int64()) for k in (2, 4, 5)), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "sha", "words", "octave", "start", "first", "cut", "tile"])

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        out = []
        for rid, octave, start, first, cut, blob in zip(*(batch[c].to_pylist() for c in ("rid", "octave", "start", "first", "cut", "tile")), strict=True):
            tile = np.frombuffer(blob, "<i4").tolist()
            out += [(rid, q, start + a, start + b) for q, a, b in solve(tile, octave, first - start, BOUNDARIES, cut - start)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["rid", "period", "a", "b"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(rid, start, length, period) of runs, from fragments (rid, period, a, b) of matching positions: those of a document
    and period that touch are one; of stretches with the same ends the smallest period stays."""
    near = Window.partitionBy("rid", "period").orderBy("a", "b")
    before = F.max("b").over(near.rowsBetween(Window.unboundedPreceding, -1))
    islands = fragments.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("rid", "period", "island").agg(F.min("a").alias("start"), F.max("b").alias("b"))
    length = F.col("b") + F.col("period") - F.col("start")
    long = whole.withColumn("length", length).where(F.col("length") >= F.greatest(F.lit(SHORTEST), TIMES * F.col("period")))
    return long.groupBy("rid", "start", "length").agg(F.min("period").alias("period"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        out = []
        for doc_id, text, runs in zip(batch["doc_id"].to_pylist(), batch["words"].to_pylist(), batch["runs"].to_pylist(), strict=True):
            words = text.split(b" ") if text else []
            found = sorted((r["start"], r["period"], r["length"]) for r in runs or ())
            drop = np.zeros(len(words) + 1, np.int64)
            for start, period, length in found:
                drop[start + period] += 1
                drop[start + length] -= 1
            kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
            out.append((doc_id, [{"start": s, "length": n, "period": q} for s, q, n in found], b" ".join([words[i] for i in kept])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array([x[2] for x in out], pa.binary())], ["doc_id", "runs", "collapsed"]
        )


def periodic_runs(spark: SparkSession, docs: DataFrame, change: Change = unchanged) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text), after ``change`` of each document's words: (doc_id, runs, collapsed) of documents with tiles,
    runs by start and period, and (doc_id, sha) of all others, which have no run and keep their words.

    collapsed is the text of kept words: of each run only the first period stays. Words are separated by ASCII white space.
    """
    keyed = docs.select(row_key().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = keep(spark, keyed.mapInArrow(_first_pass(change), "rid long, doc_id long, sha string, words binary, octave int, start long, first long, cut long, tile binary"), "tiles")
    dealt = first.where("tile is not null").select("rid", "octave", "start", "first", "cut", "tile").repartition("rid", "octave", "start")
    fragments = dealt.mapInArrow(_solved, "rid long, period long, a long, b long").distinct()
    runs = stitched(fragments).groupBy("rid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    texts = first.where("words is not null").select("rid", "doc_id", "words")
    with_tiles = texts.join(runs, "rid", "left").select("doc_id", "words", "runs").mapInArrow(_collapsed, f"doc_id long, runs array<{RUN}>, collapsed binary")
    return with_tiles, first.where("sha is not null").select("doc_id", "sha")


def run_digests(with_tiles: DataFrame, others: DataFrame) -> DataFrame:
    """periodic_runs' documents with the number of runs, the run of most periods, and digests of runs and kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            out = []
            for doc_id, runs, text in zip(batch["doc_id"].to_pylist(), batch["runs"].to_pylist(), batch["collapsed"].to_pylist(), strict=True):
                said = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                best = min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
                top = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                out.append((doc_id, len(runs), *top, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64() if k < 6 else pa.string()) for k in range(8)], COLUMNS)

    found = with_tiles.mapInArrow(run, ", ".join(f"{c} {'long' if k < 6 else 'string'}" for k, c in enumerate(COLUMNS)))
    none = F.lit(None).cast("long")
    plain = others.select("doc_id", F.lit(0).cast("long").alias("n_runs"), *(none.alias(c) for c in COLUMNS[2:6]), F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("sha").alias("collapsed_sha256"))
    return found.unionByName(plain)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
