"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that starts anywhere else too.

Not every suffix is sorted. Each window of LENGTH bytes names one K-byte string inside it, the one of least hash
(leftmost of equals), so equal windows name equal strings at equal places. The suffixes at the named places, cut
where their windows end, are the sparse suffix array of the corpus:

1. Named strings found only once in the corpus are dropped (their hashes meet by hash).
2. Each task sorts its other suffixes, folds equal ones into one, front-codes the sorted run (common prefix with
   the one before, then the rest) and hands each part of the name space its piece of the run.
3. Each part combines its runs with a loser tree that carries common-prefix lengths, so bytes that are known to
   agree are never compared again, and reads from prefix lengths and from what stands before the named place which
   windows occur twice.
4. The spans come back to their documents and are cut out.

Strings that are frequent in a bounded sample of documents are named last: windows that hold anything else name
that, so the suffixes that still begin with a frequent string lie inside a repeated passage and fold into few.
Any sample gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import keep, maybe_in, mix64, parted, rows, shuffle_partitions, signed

K = 32
_MULTIPLIER = 0xD1342543DE82EF95
_INVERSE = pow(_MULTIPLIER, -1, 2**64)


@dataclass(frozen=True)
class Dedup:
    length: int = 400
    #: Documents sampled for frequent strings, and the least number of them that must hold such a string.
    sample_documents: int = 1000
    sample_least: int = 6
    sample_entries: int = 300_000
    #: Bytes of suffixes that a task gathers before it sorts them and hands them on.
    flush: int = 48_000_000


class Powers:
    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, _MULTIPLIER, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, _INVERSE, np.uint64))])
        return self.up[:n], self.down[:n]


def string_hashes(data: np.ndarray, powers: Powers) -> np.ndarray:
    """The hash of the K bytes from each place."""
    n = len(data)
    up, down = powers.to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix64((total[K:] - total[:-K]) * down[: n - K + 1])


#: No column holds a longer text.
PLACE_BITS = 31


def named(hashes: np.ndarray, frequent: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that windows of length bytes name, with the first and the last window start that names each."""
    width, n = length - K + 1, len(hashes)
    order = hashes >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        order |= (frequent[at] == hashes).astype(np.uint64) << np.uint64(63)
    order = (order & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.uint64(2**64 - 1))
    grid[:n] = order
    grid = grid.reshape(blocks, width)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[: n - width + 1], before[width - 1 : n])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[start], start, np.append(start[1:], len(place)) - 1


def _frequent(d: Dedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in rows(batches, 256):
            seen = [np.unique(string_hashes(np.frombuffer(t, np.uint8), powers)) for t in batch.column("text").to_pylist() if len(t) >= K]
            name, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(n.astype(np.int64))], ["name", "n"])

    return run


def frequent_strings(docs: DataFrame, d: Dedup) -> np.ndarray:
    mod = max(1, docs.count() // d.sample_documents)
    sample = docs.where(F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(mod)) == 0).select("text")
    counts = sample.mapInArrow(_frequent(d), "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    got = counts.where(F.col("n") >= d.sample_least).orderBy(F.col("n").desc(), "name").limit(d.sample_entries).toArrow()
    return np.sort(got.column("name").to_numpy().astype(np.int64).view(np.uint64))


BLOBS = "p int, kind int, blob binary"


def _names(d: Dedup, parts: int, frequent):
    """For each part, the names (hashes of named strings) of its share and the rows that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0
        for batch in rows(batches):
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if len(text) >= d.length:
                    h = string_hashes(np.frombuffer(text, np.uint8), powers)
                    name = h[named(h, frequent.value, d.length)[0]]
                    held.append((rid, name))
                    size += len(name)
            if size > 2_000_000:
                yield from _name_parts(held, parts)
                held, size = [], 0
        if held:
            yield from _name_parts(held, parts)

    return run


def _name_parts(held: list, parts: int) -> Iterator[pa.RecordBatch]:
    name = np.concatenate([x for _, x in held])
    rid = np.repeat(np.array([r for r, _ in held], np.int64), [len(x) for _, x in held])
    yield from parted((name % np.uint64(parts)).astype(np.int32), 0, [name, rid])


def _repeated(key, table):
    """(rid, name) of the names that are found twice or more."""
    name, rid = [], []
    for blob in table.column("blob").to_pylist():
        n = len(blob) // 16
        name.append(np.frombuffer(blob, np.uint64, n))
        rid.append(np.frombuffer(blob, np.int64, n, 8 * n))
    name, rid = np.concatenate(name), np.concatenate(rid)
    order = np.lexsort((rid, name))
    name, rid = name[order], rid[order]
    same = name[1:] == name[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    name, rid = name[twice], rid[twice]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (rid[1:] != rid[:-1])
    return pa.table([pa.array(rid[fresh]), pa.array(signed(name[fresh]))], ["rid", "name"])


def first_difference(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which known bytes are known."""
    end = min(len(a), len(b))
    x = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (x.bit_length() + 7) // 8


def front_coded(run: list[tuple]) -> bytes:
    """run: sorted (right, left, rid or 0, start or -1). Header of six numbers for each, then the bytes of all."""
    head, body, before = np.zeros((len(run), 6), np.int64), [], b""
    for i, (right, left, rid, start) in enumerate(run):
        common = first_difference(before, right, 0)
        head[i] = common, len(right) - common, len(left), rid, start, 0
        body += [right[common:], left]
        before = right
    return len(run).to_bytes(8, "little") + head.tobytes() + b"".join(body)


def front_decoded(blob: bytes) -> Iterator[tuple]:
    """The sorted (right, common prefix with the one before, left, rid, start) of a run."""
    n = int.from_bytes(blob[:8], "little")
    head, at, before = np.frombuffer(blob, np.int64, 6 * n, 8).reshape(n, 6).tolist(), 8 + 48 * n, b""
    for common, more, left, rid, start, _ in head:
        before = before[:common] + blob[at : at + more]
        yield before, common, blob[at + more : at + more + left], rid, start
        at += more + left


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Combines sorted runs with a loser tree. Each head keeps its common prefix with the last one given out:
    of two heads the one with the longer prefix is the smaller, and only equal prefixes compare further bytes."""
    k = 1
    while k < max(2, len(runs)):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    prefix = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes the one it has with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        common = first_difference(x[0], y[0], prefix[a])
        if x[0][common : common + 1] <= y[0][common : common + 1]:
            prefix[b] = common
            return a, b
        prefix[a] = common
        return b, a

    tree, level = [0] * k, list(range(k))
    at = k
    while len(level) > 1:
        at //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, loser = play(level[i], level[i + 1])
            tree[at + i // 2] = loser
            nxt.append(w)
        level = nxt
    winner = level[0]
    while heads[winner] is not None:
        right, _, left, rid, start = heads[winner]
        yield right, prefix[winner], left, rid, start
        heads[winner] = next(runs[winner], None)
        prefix[winner] = heads[winner][1] if heads[winner] is not None else 0
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def repeated_windows(group: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """group: sorted (right, prefix with the one before, left, ...) that begin with one named string. For each, the
    ranges (first, last) of j such that its window from j bytes before the named place occurs in another too."""
    n = len(group)
    most = [len(g[2]) for g in group]
    least = [len(g[2]) - (len(g[2]) + len(g[0]) - length) for g in group]
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    if n <= 6:
        for a in range(n):
            reach = length
            for b in range(a + 1, n):
                reach = min(reach, group[b][1])
                x, y = group[a][2], group[b][2]
                low = max(length - reach, least[a], least[b])
                if low <= min(most[a], most[b]):
                    high = min(first_difference(x[::-1], y[::-1], 0), most[a], most[b])
                    if low <= high:
                        out[a].append((low, high))
                        out[b].append((low, high))
        return out
    prefix = np.array([g[1] for g in group])
    prefix[0] = 0
    back = [g[2][::-1] for g in group]
    order = sorted(range(n), key=back.__getitem__)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    left = np.array([0] + [first_difference(back[p], back[q], 0) for p, q in zip(order, order[1:], strict=False)])
    low, high = np.array(least), np.array(most)
    open_: dict[int, int] = {}
    for j in range(max(0, int(low.min())), int(high.max()) + 2):
        valid = np.flatnonzero((low <= j) & (j <= high))
        right_class = np.cumsum(prefix < length - j)[valid]
        left_class = (np.cumsum(left < j) if j else np.zeros(n, np.int64))[place[valid]]
        key = right_class * np.int64(n + 1) + left_class
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = set(valid[times[inverse] > 1].tolist()) if len(valid) else set()
        for i in [i for i in open_ if i not in twice]:
            out[i].append((open_.pop(i), j - 1))
        for i in twice:
            open_.setdefault(i, j)
    return out


def _runs(d: Dedup, parts: int, frequent):
    """Sorted, folded, front-coded runs of suffixes (kind 1); spans that a task can tell by itself (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            held.sort()
            spans, runs, at = [], {}, 0
            while at < len(held):
                end = at + 1
                while end < len(held) and held[end][:3] == held[at][:3]:
                    end += 1
                part, right, left, rid, start = held[at]
                if end - at > 1:
                    spans += [(x[3], x[4], x[4] + len(left) + len(right)) for x in held[at:end]]
                    rid, start = 0, -1
                runs.setdefault(part, []).append((right, left, rid, start))
                at = end
            if spans:
                a = np.array(spans, np.int64)
                yield from parted((mix64(a[:, 0].view(np.uint64)) % np.uint64(parts)).astype(np.int32), 0, [a[:, 0], a[:, 1], a[:, 2]])
            for part, x in runs.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([front_coded(x)], pa.binary())], ["p", "kind", "blob"])
            held.clear()

        for batch in rows(batches):
            for rid, text, names in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("names").to_numpy(zero_copy_only=False), strict=True):
                h = string_hashes(np.frombuffer(text, np.uint8), powers)
                place, first, last = named(h, frequent.value, d.length)
                wanted = np.isin(signed(h[place]), names)
                part = (h[place] % np.uint64(parts)).astype(np.int64)
                for p, a, x, y in zip(part[wanted].tolist(), place[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                    held.append((p, text[a : y + d.length], text[x:a], rid, x))
                    size += y + d.length - x
            if size > d.flush:
                yield from out()
                size = 0
        yield from out()

    return run


def _combine(d: Dedup):
    def run(key, table):
        spans, runs = [np.zeros((3, 0), np.int64)], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind:
                runs.append(front_decoded(blob))
            else:
                spans.append(np.frombuffer(blob, np.int64).reshape(3, -1))
        found: list[tuple] = []

        def close(group: list[tuple]) -> None:
            if len(group) > 1:
                for (_, _, left, rid, start), ranges in zip(group, repeated_windows(group, d.length), strict=True):
                    if start >= 0:
                        found.extend((rid, start + len(left) - high, start + len(left) - low + d.length) for low, high in ranges)

        group: list[tuple] = []
        for item in merged(runs):
            if group and item[1] < K:
                close(group)
                group = []
            group.append(item)
        close(group)
        if found:
            spans.append(np.array(found, np.int64).T)
        x = np.concatenate(spans, 1)
        return pa.table([pa.array(c) for c in x], ["rid", "first", "last"])

    return run


def joined_spans(first: list[int], last: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(spark: SparkSession, docs: DataFrame, dedup: Dedup = Dedup()) -> DataFrame:
    """docs(rid, text as bytes) -> rid, first, last: byte ranges that a repeated string of the length covers."""
    d = dedup
    parts = 4 * shuffle_partitions(spark)
    frequent = spark.sparkContext.broadcast(frequent_strings(docs, d))
    names = docs.mapInArrow(_names(d, parts, frequent), BLOBS).groupBy("p").applyInArrow(_repeated, "rid bigint, name bigint")
    names = keep(spark, names.groupBy("rid").agg(F.collect_list("name").alias("names")), "names")
    likely = maybe_in(docs, names, "rid").where("likely").select("rid", "text")
    runs = likely.join(names, "rid").select("rid", "text", "names").mapInArrow(_runs(d, parts, frequent), BLOBS)
    return runs.groupBy("p").applyInArrow(_combine(d), "rid bigint, first bigint, last bigint")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        out = []
        for doc_id, text, first, last in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "firsts", "lasts")), strict=True):
            spans = joined_spans(first or [], last or [])
            left, at = [], 0
            for a, b in spans:
                left.append(text[at:a])
                at = b
            left = b"".join([*left, text[at:]])
            out.append((doc_id, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def suffix_dedup(spark: SparkSession, docs: DataFrame, dedup: Dedup = Dedup()) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes); one row for each input row.

    Null text: empty. Texts shorter than the length lose nothing. A row that is there twice repeats itself, so it
    loses all of its windows in both. An empty table gives an empty result; more columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return _with_spans(spark, docs, dedup).select("doc_id", "text", "firsts", "lasts").mapInArrow(_cut, CUT)


def cut_repeats(spark: SparkSession, docs: DataFrame, dedup: Dedup = Dedup()) -> DataFrame:
    """The rows of docs with all their columns; text without the repeated bytes, and without pieces of characters
    that a cut left. Null text becomes empty."""
    marked = _with_spans(spark, docs.withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b""))), dedup)
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return marked.select(*docs.columns, "firsts", "lasts").mapInArrow(_cut_text, out.schema).select(*docs.columns)


def _with_spans(spark: SparkSession, docs: DataFrame, dedup: Dedup) -> DataFrame:
    """docs with arrays of the first and last bytes (exclusive) of what is repeated."""
    own = docs.columns
    docs = docs.withColumn("rid", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text"))
    spans = repeated_spans(spark, docs.where(F.octet_length("text") >= dedup.length).select("rid", "text"), dedup)
    spans = keep(spark, spans.groupBy("rid").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")), "spans")
    marked = maybe_in(docs, spans, "rid")
    none = F.array().cast("array<bigint>")
    alone = marked.where(~F.col("likely")).select(*own, none.alias("firsts"), none.alias("lasts"))
    hit = marked.where("likely").select("rid", *own).join(spans, "rid", "left").select(*own, "firsts", "lasts")
    return alone.union(hit)


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        texts = []
        for text, first, last in zip(*(batch.column(c).to_pylist() for c in ("text", "firsts", "lasts")), strict=True):
            left, at = [], 0
            for a, b in joined_spans(first or [], last or []):
                left.append(text[at:a])
                at = b
            texts.append(b"".join([*left, text[at:]]).decode("utf-8", "ignore"))
        names = [n for n in batch.schema.names if n not in ("firsts", "lasts")]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)
