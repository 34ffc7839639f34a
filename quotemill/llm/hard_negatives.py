"""Hard negatives by inner product, with LEMP's length buckets and coordinate pruning.

Each anchor's positives are its best rows of the same label; its negatives for a positive are the best rows of other labels
with a score within a band of the positive's score.

1. Rows are sorted by length over the cluster and cut into shards of bounded size, in each of them buckets of like length.
   A bucket keeps its unit vectors' values of every coordinate as sorted lists.
2. Anchors are packed into blocks. Every block meets the shard of the longest rows first. What it finds there is the
   anchors' threshold for all other shards; a shard too short for every anchor of a block is not sent to it.
3. In a bucket of length l an anchor of length a needs rows at an angle of at most acos(threshold / (a l)). Each of its
   focus coordinates, the largest by size, gives a feasible range of values; the rows in all ranges are verified exactly.
   Where a range covers most of a bucket, the whole bucket is multiplied with such anchors at once.

Scores are exact integers. Pruning never loses a row: thresholds are inclusive and angles get a margin for rounding.

Rows without a vec_id, label or vector, with a null or non-finite component, or with one beyond +-2^26 after scaling (scores
would leave a long) take no part. Of rows that share a vec_id the one of the smallest label and vector counts. Vectors of different sizes are
compared over their common components, the rest counts as zero. Columns other than the three are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.llm.common import keep, shuffle_partitions

#: Rows of a shard at most, rows of a bucket, anchors of a block.
SHARD_ROWS, BUCKET_ROWS, BLOCK_ANCHORS = 131_072, 2_048, 512
#: Coordinates that an anchor looks up in a bucket, and the share of a bucket from which on all of it is multiplied.
FOCUS, DENSE = 3, 0.25
#: Of an angle, for rounding.
MARGIN = 1e-6
LIMIT = 1 << 26
NONE = np.iinfo(np.int64).min

PACKED = "longest double, ids binary, labels binary, vectors binary, width int, wide boolean"


def scaled_rows(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v array<long>, sq double) of the rows that take part: components as floor(scale * x)."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LIMIT))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("v"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    return one.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


KINDS = [pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()]


def _packed(name: int, table: pa.Table, first: str = "name") -> pa.Table:
    """One row with all ids, labels and vectors of some rows; shorter vectors get zeros."""
    lists = table["v"].to_pylist()
    width = max(map(len, lists), default=0)
    full = np.array([v + [0] * (width - len(v)) for v in lists], np.int64).reshape(len(lists), width)
    wide = bool(np.abs(full).max(initial=0) >= 1 << 15)
    longest = math.sqrt(max(table["sq"].to_pylist(), default=0.0))
    values = [name, longest, table["vec_id"].to_numpy().tobytes(), table["label"].to_numpy().astype("<i4").tobytes(), full.astype("<i8" if wide else "<i2").tobytes(), width, wide]
    return pa.table([pa.array([v], k) for v, k in zip(values, KINDS, strict=True)], [first, "longest", "ids", "labels", "vectors", "width", "wide"])


def _shards(size: int):
    """A task's rows, sorted by length, in runs of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, waiting, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(waiting)
                yield from _packed(name, table.slice(0, size)).to_batches()
                name, n, waiting = name + 1, n - size, table.slice(size).to_batches()
        if n:
            yield from _packed(name, pa.Table.from_batches(waiting)).to_batches()

    return run


def _anchor_block(key: tuple, table: pa.Table) -> pa.Table:
    return _packed(key[0].as_py(), table, "block")


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors (int64) of a packed block."""
    ids, labels = np.frombuffer(row[f"{side}ids"], "<i8"), np.frombuffer(row[f"{side}labels"], "<i4")
    vectors = np.frombuffer(row[f"{side}vectors"], "<i8" if row[f"{side}wide"] else "<i2").astype(np.int64)
    return ids, labels, vectors.reshape(len(ids), row[f"{side}width"])


class Bucket:
    """Rows of like length, with a sorted list of every coordinate of their unit vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        self.unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0)
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)

    def products(self, anchors: np.ndarray, lengths: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Exact scores of anchors (A, d) with rows (all, or some): (A, R). Floats are exact while no sum reaches 2^53."""
        own = self.vectors if rows is None else self.vectors[rows]
        if float(lengths.max(initial=0)) * self.longest < 1 << 52:
            return (anchors.astype(np.float64) @ own.astype(np.float64).T).astype(np.int64)
        return anchors @ own.T


def least_cosines(thresholds: np.ndarray, lengths: np.ndarray, bucket: Bucket) -> np.ndarray:
    """The cosine that a row of the bucket needs for each anchor; over 1: none can reach the threshold; -1: all may."""
    low = np.where(thresholds > 0, lengths * bucket.longest, lengths * bucket.shortest)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(low > 0, thresholds / low, np.where(thresholds > 0, 2.0, -1.0))
    return np.maximum(need - MARGIN, -1.0)


def feasible(bucket: Bucket, unit: np.ndarray, need: float) -> np.ndarray | None:
    """Rows whose focus coordinates all lie in the ranges that the cosine allows; None where the ranges are wide."""
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    angle = math.acos(min(1.0, need))
    ranges = []
    for f in focus.tolist():
        own = math.acos(max(-1.0, min(1.0, unit[f])))
        least, most = math.cos(min(math.pi, own + angle)) - MARGIN, math.cos(max(0.0, own - angle)) + MARGIN
        a, b = np.searchsorted(bucket.lists[:, f], [least, most + MARGIN])
        ranges.append((int(b - a), f, int(a), int(b), least, most))
    ranges.sort()
    size, f, a, b, _, _ = ranges[0]
    if size > DENSE * len(bucket.ids):
        return None
    rows = bucket.order[a:b, f]
    for _, f, _, _, least, most in ranges[1:]:
        values = bucket.unit[rows, f]
        rows = rows[(values >= least) & (values <= most)]
    return rows


class Best:
    """The first k (score, id) of each query with a score within bounds: higher scores first, then smaller ids."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.high = k, high
        self.floor = low.copy()  # the score from which on a row can still be among the first k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.floor[query]) & (scores <= self.high[query])
        if not fits.any():
            return
        s, i = (np.concatenate(x) for x in zip(self.found[query], (scores[fits], ids[fits]), strict=True))
        first = np.lexsort((i, -s))[: self.k]
        self.found[query] = s[first], i[first]
        if len(first) == self.k:
            self.floor[query] = max(self.floor[query], self.found[query][0][-1])


def search(anchors: tuple[np.ndarray, np.ndarray, np.ndarray], shard: tuple[np.ndarray, np.ndarray, np.ndarray], best: Best, queries: np.ndarray, same: bool, bucket_rows: int = BUCKET_ROWS) -> None:
    """Adds a shard's rows of the anchors' labels (or of other labels) to what each of their queries has found.

    queries[a] holds the numbers of anchor a's queries in ``best`` (-1: none)."""
    a_ids, a_labels, a_vectors = anchors
    ids, labels, vectors = shard
    width = max(a_vectors.shape[1], vectors.shape[1])
    a_vectors, vectors = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (a_vectors, vectors))
    lengths, a_lengths = (np.sqrt((v.astype(np.float64) ** 2).sum(1)) for v in (vectors, a_vectors))
    units = a_vectors / np.maximum(a_lengths, 1e-300)[:, None]
    order = np.argsort(-lengths, kind="stable")
    known = queries >= 0
    asked = known.any(1)
    for at in range(0, len(order), bucket_rows):
        rows = order[at : at + bucket_rows]
        bucket = Bucket(ids[rows], labels[rows], vectors[rows], lengths[rows])
        floors = np.where(known, best.floor[queries], np.iinfo(np.int64).max).min(1)
        need = np.where(floors == NONE, -1.0, least_cosines(floors.astype(np.float64), a_lengths, bucket))
        dense = []
        for a in np.flatnonzero(asked & (need <= 1)).tolist():
            some = feasible(bucket, units[a], need[a]) if need[a] > -1 and a_lengths[a] > 0 else None
            if some is None:
                dense.append(a)
            elif len(some):
                _offer(best, queries[a], bucket, some, bucket.products(a_vectors[a : a + 1], a_lengths[a : a + 1], some)[0], a_ids[a], a_labels[a], same)
        if dense:
            scores = bucket.products(a_vectors[dense], a_lengths[dense])
            near = (scores >= floors[dense][:, None]) & ((bucket.labels[None, :] == a_labels[dense][:, None]) == same)
            for k, a in enumerate(dense):
                some = np.flatnonzero(near[k])
                if len(some):
                    _offer(best, queries[a], bucket, some, scores[k, some], a_ids[a], a_labels[a], same)


def _offer(best: Best, queries: np.ndarray, bucket: Bucket, some: np.ndarray, scores: np.ndarray, anchor: int, label: int, same: bool) -> None:
    ok = ((bucket.labels[some] == label) == same) & (bucket.ids[some] != anchor)
    scores, ids = scores[ok], bucket.ids[some][ok]
    for q in queries[queries >= 0].tolist():
        best.add(q, scores, ids)


def _bounds(row: dict, n: int, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper bounds and the query numbers of a block's anchors; ``bounds`` holds (low, high) of n x per queries."""
    bounds = np.frombuffer(row["bounds"], "<i8").reshape(n, per, 2)
    queries = np.arange(n * per).reshape(n, per)
    queries[bounds[:, :, 0] > bounds[:, :, 1]] = -1
    return bounds[:, :, 0].reshape(-1).copy(), bounds[:, :, 1].reshape(-1).copy(), queries


def _search_rows(k: int, per: int, same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (block of anchors, shard): the queries' first k, and the bounds as they are then."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            anchors, shard = _unpacked(row, "a_"), _unpacked(row, "")
            low, high, queries = _bounds(row, len(anchors[0]), per)
            best = Best(k, low, high)
            search(anchors, shard, best, queries, same)
            sizes = [len(s) for s, _ in best.found]
            number = np.repeat(np.arange(len(sizes)), sizes)
            scores, ids = (np.concatenate([x[j] for x in best.found] + [np.zeros(0, np.int64)]) for j in (0, 1))
            bounds = np.stack([best.floor, high], 1).astype("<i8").tobytes()
            floor = int(best.floor[best.floor <= high].min(initial=np.iinfo(np.int64).max))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int64()), pa.array([bounds], pa.binary()), pa.array([floor], pa.int64()), pa.array([anchors[0][number // per].tolist()], pa.list_(pa.int64())), pa.array([(number % per).tolist()], pa.list_(pa.int32())), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([scores.tolist()], pa.list_(pa.int64()))],
                ["block", "bounds", "floor", "anchors", "slots", "ids", "scores"],
            )


def _searched(spark: SparkSession, blocks: DataFrame, shards: DataFrame, k: int, per: int, same: bool, tag: str) -> DataFrame:
    """(anchor_id, slot, row_id, score): a superset of each query's first k, from blocks(block, bounds, ...) and all shards."""
    schema = "block long, bounds binary, floor long, anchors array<long>, slots array<int>, ids array<long>, scores array<long>"
    find = partial(_search_rows, k, per, same)
    # one short row for each shard, the longest first
    reach = keep(spark, shards.select("name", "longest", (F.row_number().over(Window.orderBy(F.col("longest").desc(), "name")) - 1).alias("number")).withColumnRenamed("longest", "reach"), f"{tag}_reach")
    n = reach.count()
    sides = blocks.select("block", "bounds", *(F.col(c).alias(f"a_{c}") for c in ("longest", "ids", "labels", "vectors", "width", "wide")))
    rows = shards.drop("longest")
    met = sides.drop("a_longest").withColumn("number", F.lit(0)).join(reach, "number").select("name", *(c for c in sides.columns if c != "a_longest"))
    first = keep(spark, met.repartition("block").join(rows, "name").mapInArrow(find, schema), f"{tag}_first")
    raised = keep(spark, sides.drop("bounds").join(first.select("block", "bounds", "floor"), "block"), f"{tag}_raised")
    # a block is sent to the shards that its threshold leaves
    due = raised.select("block", "a_longest", "floor", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("number")) if n > 1 else raised.select("block", "a_longest", "floor", F.lit(-1).alias("number"))
    due = due.join(reach, "number").where((F.col("floor") <= 0) | (F.col("a_longest") * F.col("reach") * (1 + MARGIN) >= F.col("floor"))).select("block", "name")
    rest = raised.drop("floor", "a_longest").join(due, "block").join(rows, "name").mapInArrow(find, schema)
    found = first.unionByName(keep(spark, rest, f"{tag}_rest")).select(F.explode(F.arrays_zip("anchors", "slots", "ids", "scores")).alias("f"))
    return found.select(F.col("f.anchors").alias("anchor_id"), F.col("f.slots").alias("slot"), F.col("f.ids").alias("row_id"), F.col("f.scores").alias("score"))


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "row_id")
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(spark: SparkSession, df: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the rows of df(vec_id,
    embedding, label) whose vec_id is divisible by ``every``: of each positive the first ``negatives`` rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score."""
    rows = keep(spark, scaled_rows(df), "scaled")
    n, n_anchors = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    parts = max(shuffle_partitions(spark), -(-n // shard_rows))
    by_length = rows.repartitionByRange(parts, F.col("sq").desc(), F.xxhash64("vec_id")).sortWithinPartitions(F.col("sq").desc(), "vec_id")
    shards = keep(spark, by_length.mapInArrow(_shards(shard_rows), f"name long, {PACKED}"), "shards")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n_anchors // block_anchors))))
    blocks = keep(spark, rows.where(F.col("vec_id") % every == 0).groupBy(block.alias("block")).applyInArrow(_anchor_block, f"block long, {PACKED}"), "anchors")
    any_score = np.array([NONE, np.iinfo(np.int64).max], "<i8").tobytes().hex()
    unbounded = blocks.withColumn("bounds", F.unhex(F.repeat(F.lit(any_score), (F.length("ids") / 8).cast("int"))))
    near = _searched(spark, unbounded, shards, positives, 1, True, "positives")
    best = keep(spark, _first(near, ["anchor_id"], positives).select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "best")
    places = blocks.select("block", "ids").mapInArrow(_block_ids, "block long, place int, anchor_id long")
    scored = places.join(best, "anchor_id").groupBy("block").agg(F.collect_list(F.struct("place", "slot", "positive_score")).alias("scored"))  # at most block_anchors x positives
    bounded = keep(spark, blocks.join(scored, "block", "left").mapInArrow(partial(_banded, positives, low, high), f"block long, {PACKED}, bounds binary"), "bounded")
    found = _searched(spark, bounded, shards, negatives, positives, False, "negatives")
    out = _first(found, ["anchor_id", "slot"], negatives).join(best, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, blob in zip(batch["block"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            ids = np.frombuffer(blob, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["block", "place", "anchor_id"])


def _banded(positives: int, low: int, high: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the band of scores of each positive of each anchor; an anchor without a positive has no query there."""
    columns = ["block", "longest", "ids", "labels", "vectors", "width", "wide"]
    for batch in batches:
        out = []
        for blob, scored in zip(batch["ids"].to_pylist(), batch["scored"].to_pylist(), strict=True):
            bounds = np.empty((len(blob) // 8, positives, 2), "<i8")
            bounds[:] = (1, 0)
            for x in scored or ():
                bounds[x["place"], x["slot"]] = -(-low * x["positive_score"] // 100), high * x["positive_score"] // 100
            out.append(bounds.tobytes())
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(out, pa.binary())], [*columns, "bounds"])
