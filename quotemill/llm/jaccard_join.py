"""N-gram Jaccard join: universe partition with the pigeonhole principle, exact verification, components.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets of sizes n and m at similarity t
differ in at most H = (n + m)(1 - t) / (1 + t) members. Hashes are dealt to the segments of a size band; every
segment in which two sets differ holds at least one of the H members, so a set with s segments in use agrees with
each partner in s - H of them. What a segment holds is indexed by the hash of the whole subset.

Costs decide what is indexed (allocation 0, 1 or 2 for a segment):
 * s - H - 1 subsets may be left out (0), the costliest first. Costs are counts in a share of the documents, then
   small subsets before large ones; all sets leave out by the same order, so the cheapest subset that two partners
   share stays in both. The table of counts has a bound, which is what is broadcast.
 * the other subsets are indexed whole (1);
 * a set with s <= H also indexes the subsets with one member left out (2): partners then differ by at most one
   member in some segment. Where even that falls short (very small sets), it indexes each member too.
Any sample gives the same links; it only changes how many candidates are compared.

Candidates pass a bitmap first: each set keeps the parities of its members' hash slots, two to four bits for each
member. Members that differ flip a bit each at most, so more unequal bits than H rule a pair out. What is left is
compared exactly, on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import WordHashes, keep, maybe_in, mix64, parted, row_key, rows, shingles, shuffle_partitions, signed
from quotemill.llm.graph import add_links, connected_components


@dataclass(frozen=True)
class Join:
    size: int = 5
    #: Two documents link when 100 * shared >= percent * union.
    percent: int = 75
    #: One document in so many has its subsets counted for the costs; subsets kept at most (the most frequent), and the
    #: least count that makes one costly.
    cost_share: int = 12
    cost_entries: int = 1_000_000
    cost_least: int = 2
    #: Index entries that a task gathers before it hands them on.
    flush: int = 3_000_000
    #: Index groups of at most this many sets give all their pairs at once.
    small_group: int = 6
    #: Turns in which the members of larger groups meet one member, before those in different components are compared.
    star_turns: int = 1


def bounds(n: int, percent: int) -> tuple[int, int]:
    """Least and greatest size of a partner."""
    return -(-n * percent // 100), n * 100 // percent


def most_apart(n: int, m: int, percent: int) -> int:
    """Members by which partners of sizes n and m may differ."""
    return (n + m) - 2 * (-(-(n + m) * percent // (100 + percent)))


def band(n: int) -> int:
    return n.bit_length()


def segments_of(level: int) -> int:
    """More segments than the 0.4 per member of the largest sets of a band and the next part of a band above it
    that keep s > H on average; small sets get more, so that members seldom share one."""
    largest = (1 << level) * 4 // 3
    return max(1 + int(largest * 0.45), 64)


def level_subsets(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h: sorted hashes. The hash of each non-empty segment's subset, its size and its start in h."""
    m = segments_of(level)
    segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    total = np.add.reduceat(mix64(h + np.uint64(1)), start)
    return mix64(total + segment[start] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)), np.diff(np.append(start, len(h))), start


def index_entries(h: np.ndarray, percent: int, costs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """All index entries of a set, of its own band and, where a partner may be in it, of the band below."""
    n, out = len(h), []
    low, high = bounds(n, percent)
    for level in (band(n), band(n) - 1):
        # the band is that of the smaller of two partners, so in the band below the partner is small
        largest = high if level == band(n) else min(n, (1 << level) - 1)
        if largest < low:
            continue
        apart = max(most_apart(n, m, percent) for m in range(max(low, largest - 2), largest + 1))
        if apart < 1:
            continue  # only equal sets reach the similarity, and those are one node
        names, size, start = level_subsets(h, level)
        spare = len(names) - apart - 1
        if spare > 0:
            at = np.minimum(np.searchsorted(costs[0], names), max(len(costs[0]) - 1, 0))
            cost = np.where(costs[0][at] == names, costs[1][at], 0) if len(costs[0]) else np.zeros(len(names), np.int64)
            names = names[np.lexsort((names, -size, cost))[: len(names) - spare]]
        elif spare < 0:
            out.append(_without_one(h, size, start, level))
            if int(np.minimum(size, 2).sum()) <= apart:
                out.append(mix64(h ^ np.uint64(level + 1)))
        out.append(names)
    return out


def _without_one(h: np.ndarray, size: np.ndarray, start: np.ndarray, level: int) -> np.ndarray:
    """The subsets of two members or more, each with one member left out."""
    m = segments_of(level)
    each = mix64(h + np.uint64(1))
    total = np.repeat(np.add.reduceat(each, start), size)
    segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    less = mix64(total - each + segment * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
    return less[np.repeat(size, size) >= 2]


def set_id(h: np.ndarray) -> int:
    """Equal sets share it: a hash of the members and of their number."""
    if not len(h):
        return 0
    total = mix64(h + np.uint64(7)).sum(dtype=np.uint64, keepdims=True)
    return int(mix64(total ^ np.uint64(len(h) * 0xD6E8FEB86659FD93 & (2**64 - 1))).view(np.int64)[0])


def _sample_costs(j: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in rows(batches):
            found = []
            for text in batch.column("text").to_pylist():
                h = shingles(words.of((text or b"").lower().split()), j.size)
                found += [level_subsets(h, level)[0] for level in ((band(len(h)), band(len(h)) - 1) if len(h) > 2 else ())]
            if not found:
                continue
            name, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(n.astype(np.int64))], ["name", "n"])

    return run


def subset_costs(spark: SparkSession, docs: DataFrame, j: Join) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent subsets of a share of the documents, of a bounded number, and their counts."""
    sample = docs.where(F.pmod(F.xxhash64("key"), F.lit(j.cost_share)) == 0).select("text")
    counts = sample.mapInArrow(_sample_costs(j), "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= j.cost_least)
    counts = keep(spark, counts, "costs")
    kept, least = 0, 1 << 62
    for row in counts.groupBy("n").agg(F.count("*").alias("names")).orderBy(F.desc("n")).collect():  # a row for each count
        kept += row["names"]
        if kept > j.cost_entries:
            break
        least = row["n"]
    got = counts.where(F.col("n") >= least).toArrow()
    name, n = got.column("name").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(name)
    return name[order], n[order]


def parity_bits(h: np.ndarray) -> bytes:
    """Bit i: whether an odd number of members have the slot i."""
    bits = 64
    while bits < 2 * len(h):
        bits *= 2
    flips = np.bincount((mix64(h ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def unequal_bits(a: bytes, b: bytes) -> int:
    """Of two bitmaps; the longer is folded, which keeps parities."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


INDEX = "p int, kind int, blob binary"


def _index(j: Join, parts: int, costs):
    """Emits for each part p the entries that fall to it (kind 1: hash, set) and the documents (kind 0: id, size, set,
    row key, whether the id is null, and where their bitmap ends in the bytes that follow)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, docs, size, sets = WordHashes(), [], [], 0, set()
        table = costs.value

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                names = np.concatenate([x for x, _ in held])
                owners = np.repeat(np.array([s for _, s in held], np.int64), [len(x) for x, _ in held])
                yield from parted(((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32), 1, [(names & np.uint64(0xFFFFFFFF)).astype(np.uint32), owners])
            if docs:
                a = np.array([x[:5] for x in docs], np.int64)
                p = (mix64(a[:, 2].copy().view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(p, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(p[order])) + 1):
                    bits = [docs[i][5] for i in at]
                    columns = np.concatenate([[len(at)], *a[at].T, np.cumsum([len(b) for b in bits])]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(p[at[:1]]), pa.array([0], pa.int32()), pa.array([columns.tobytes() + b"".join(bits)], pa.binary())], ["p", "kind", "blob"])
            held.clear()
            docs.clear()

        for batch in rows(batches):
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                h = shingles(words.of((text or b"").lower().split()), j.size)
                s = set_id(h)
                docs.append((doc_id or 0, len(h), s, key, doc_id is None, parity_bits(h) if len(h) and s not in sets else b""))
                if len(h) and s not in sets:
                    sets.add(s)
                    for names in index_entries(h, j.percent, table):
                        held.append((names, s))
                        size += len(names)
                if size > j.flush or len(docs) > j.flush:
                    yield from out()
                    size = 0
                    sets = set() if len(sets) > 1_000_000 else sets
        yield from out()

    return run


FOUND = "kind int, a bigint, b bigint, c bigint, key bigint, bits binary"


def _meet(j: Join):
    """In one part: documents pass (kind 0: id, size, set, row key), index groups give candidate pairs (1) and, if large, their members (2)."""

    def run(key, table):
        names, owners, docs, bits = [], [], [np.zeros((5, 0), np.int64)], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind:
                n = len(blob) // 12
                names.append(np.frombuffer(blob, np.uint32, n))
                owners.append(np.frombuffer(blob, np.int64, n, 4 * n))
            else:
                n = int.from_bytes(blob[:8], "little")
                *columns, ends = np.frombuffer(blob, np.int64, 6 * n, 8).reshape(6, n)
                docs.append(np.stack(columns))
                at = 8 + 48 * n
                bits += [blob[at + a : at + b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        out = [np.stack([np.zeros(docs.shape[1], np.int64), *docs]) for docs in [np.concatenate(docs, 1)]]
        if names:
            name, owner = np.concatenate(names), np.concatenate(owners)
            order = np.argsort(name, kind="stable")
            name, owner = name[order], owner[order]
            shared = np.zeros(len(name), bool)
            same = name[1:] == name[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            name, owner = name[shared], owner[shared]
            order = np.lexsort((owner, name))
            name, owner = name[order], owner[order]
            fresh = np.ones(len(name), bool)
            fresh[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
            name, owner = name[fresh], owner[fresh]
            start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(name)))
            of, place = np.repeat(start, size), np.arange(len(name)) - np.repeat(start, size)
            pairs = [(owner[of[place > 0]], owner[place > 0])]
            few = np.repeat(size, size) <= j.small_group
            for gap in range(1, j.small_group):
                at = np.flatnonzero(few & (place > gap))
                pairs.append((owner[at - gap], owner[at]))
            a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
            order = np.lexsort((b, a))
            ab = np.stack([a, b])[:, order]
            ab = ab[:, np.concatenate([[True], (ab[:, 1:] != ab[:, :-1]).any(0)])[: ab.shape[1]]]
            out.append(np.stack([np.ones(ab.shape[1], np.int64), *ab, *np.zeros((3, ab.shape[1]), np.int64)]))
            many = np.repeat(size, size) > j.small_group
            out.append(np.stack([np.full(many.sum(), 2, np.int64), (np.int64(key[0].as_py()) << np.int64(32)) | name[many].astype(np.int64), owner[many], *np.zeros((3, many.sum()), np.int64)]))
        x = np.concatenate(out, 1)
        return pa.table([pa.array(x[0].astype(np.int32)), pa.array(x[1], mask=x[5] == 1), *map(pa.array, x[2:5]), pa.array(bits + [None] * (x.shape[1] - len(bits)), pa.binary())], ["kind", "a", "b", "c", "key", "bits"])

    return run


def _near(j: Join):
    """Rows (a, b, na, nb, bits_a, bits_b) -> the pairs (a, b) that the bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            columns = (batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
            ok = pa.array([unequal_bits(x, y) <= most_apart(n, m, j.percent) for n, m, x, y in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return run


def _verify(j: Join):
    """Rows (a, b, text_a, text_b) -> the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = WordHashes(), {}

        def members(name: int, text: bytes) -> np.ndarray:
            if name not in last:
                if len(last) >= 2000:
                    last.clear()
                last[name] = shingles(words.of(text.lower().split()), j.size)
            return last[name]

        for batch in rows(batches, 256):
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            ok = []
            for i in range(len(a)):
                x, y = members(a[i], ta[i]), members(b[i], tb[i])
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= j.percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, join: Join = Join()) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id; one row for each input row.

    Texts are lower-cased in A-Z and split at ASCII white space; fewer words than a shingle: the whole sequence
    as one. Without words, or null: an empty set, linked with nothing, so component_id is doc_id. Equal sets are
    one node; of near-equal sets, pairs inside a component that is already known are not compared. Repeated rows
    of a doc_id each get a row. Rows without a doc_id link like others; component_id is the least doc_id that there
    is, and null where no row of the component has one. An empty table gives an empty result; more columns are ignored.
    """
    sets, classes = _classes(spark, docs, join)
    out = sets.where("n > 0").select("doc_id", "n", "set_id").join(classes, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(sets.where("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))


def first_rows(spark: SparkSession, docs: DataFrame, join: Join = Join()) -> DataFrame:
    """key, n: the row_key of one row of each component, the first by doc_id (null last) and key, and how often that row is there."""
    sets, classes = _classes(spark, docs, join)
    first = sets.where("n > 0").select("key", "set_id").join(classes, "set_id").where("key = first_key").select("key")
    return first.union(sets.where("n = 0").select("key")).groupBy("key").agg(F.count("*").alias("n"))


def _classes(spark: SparkSession, docs: DataFrame, j: Join) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, set_id, bits) of all rows and (set_id, component_id, first_key) of all sets that are not empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), row_key().alias("key"))
    parts = 4 * shuffle_partitions(spark)
    costs = spark.sparkContext.broadcast(subset_costs(spark, docs, j))
    found = docs.mapInArrow(_index(j, parts, costs), INDEX).groupBy("p").applyInArrow(_meet(j), FOUND)
    found = keep(spark, found, "found")
    sets = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("set_id"), "key", "bits")
    nodes = keep(spark, sets.where("n > 0").groupBy("set_id").agg(F.min(F.struct(F.isnull("doc_id").alias("without"), "doc_id", "key")).alias("first"), F.first("n").alias("n"), F.max("bits").alias("bits")), "nodes")
    sized = nodes.select("set_id", "n", "bits")
    pairs = keep(spark, _likely(j, found.where("kind = 1").select("a", "b").distinct(), sized), "pairs")

    texts = _texts(spark, j, docs, nodes, pairs)
    labels = connected_components(spark, keep(spark, _linked(j, pairs, texts), "links"))
    # large index groups gave the pairs with their least member only: what lies across components is compared now
    large = keep(spark, found.where("kind = 2").select(F.col("a").alias("name"), F.col("b").alias("set_id")), "large")
    tried = pairs
    for turn in range(j.star_turns):
        member = _unsettled(spark, large, labels)
        stars = keep(spark, _likely(j, _stars(member, turn).join(tried, ["a", "b"], "left_anti"), sized), "stars")
        if stars.isEmpty():
            break
        labels = add_links(spark, labels, keep(spark, _linked(j, stars, _texts(spark, j, docs, nodes, stars)), "links"))
        tried = tried.union(stars)
    across = keep(spark, _across(j, _unsettled(spark, large, labels), sized).join(tried, ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        labels = add_links(spark, labels, keep(spark, _linked(j, across, _texts(spark, j, docs, nodes, across)), "links"))

    named = nodes.join(labels, nodes.set_id == labels.node, "left").select("set_id", "first", F.coalesce("component", "set_id").alias("component"))
    named = keep(spark, named, "named")
    least = keep(spark, named.groupBy("component").agg(F.min("first").alias("first")), "least")
    classes = named.drop("first").join(least, "component").select("set_id", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))
    return sets, keep(spark, classes, "classes")


def _likely(j: Join, pairs: DataFrame, sized: DataFrame) -> DataFrame:
    """The pairs that their sizes and bitmaps allow."""
    both = pairs.join(sized.toDF("a", "na", "bits_a"), "a").join(sized.toDF("b", "nb", "bits_b"), "b").where(_sizes_fit(j))
    return both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_near(j), "a bigint, b bigint")


def _sizes_fit(j: Join) -> F.Column:
    return (100 * F.least("na", "nb")) >= (j.percent * F.greatest("na", "nb"))


def _texts(spark: SparkSession, j: Join, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, text) of the sets that are in a pair: one row stands for each set.

    A bitmap keeps most other documents out of the shuffle; the join after it is exact.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = keep(spark, nodes.join(wanted, "set_id").select("set_id", F.col("first.key").alias("key")), "wanted")
    known = maybe_in(docs, wanted, "key").where("likely")
    stands = known.select("key", "text").join(wanted, "key").select("set_id", "text").mapInArrow(_own(j), "set_id bigint, text binary")
    return keep(spark, stands.dropDuplicates(["set_id"]), "texts")


def _own(j: Join):
    """Keeps the rows whose text has the set; others only share a key with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in rows(batches):
            same = [set_id(shingles(words.of(text.lower().split()), j.size)) == s for s, text in zip(batch.column("set_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    return run


def _linked(j: Join, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(j), "a bigint, b bigint")


def _unsettled(spark: SparkSession, large: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, set_id, label) of the large index groups whose members are in several components."""
    member = keep(spark, large.join(labels.toDF("set_id", "label"), "set_id", "left").select("name", "set_id", F.coalesce("label", "set_id").alias("label")), "member")
    groups = member.groupBy("name").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("name")
    return keep(spark, member.join(groups, "name"), "unsettled")


def _stars(member: DataFrame, turn: int) -> DataFrame:
    """Pairs of each member with one member of its group, another in each turn, where these are in different components.

    Most members of a group of near copies join its component by one of these, so a row for each member in each turn
    takes the place of most of its pairs.
    """
    middle = member.groupBy("name").agg(F.min_by(F.struct("set_id", "label"), F.xxhash64("set_id", F.lit(turn))).alias("m"))
    pairs = member.join(middle, "name").where("label <> m.label")
    return pairs.select(F.least("set_id", "m.set_id").alias("a"), F.greatest("set_id", "m.set_id").alias("b")).distinct()


#: Members of an index group that one task compares with as many others.
BLOCK = 4000
#: Names of its groups that a set carries into each of them, the least ones: a long text is in thousands of groups.
CARRIED = 16


def _across(j: Join, member: DataFrame, sized: DataFrame) -> DataFrame:
    """Pairs in different components of a large index group that sizes and bitmaps allow.

    A group of more than BLOCK members is dealt out by pairs of blocks; inside, bitmaps are compared in arrays. Only
    the pairs that they allow become rows, in the first of the groups that both are in. Where the names that they carry do
    not tell that a group is not the first, they become rows there too, and equal rows are put together.
    """
    return _dealt(member, sized).groupBy("name", "x", "y").applyInArrow(_compare(j), "a bigint, b bigint").distinct()


def _dealt(member: DataFrame, sized: DataFrame) -> DataFrame:
    """A row for each member of a group and block that it meets, with its bitmap and the least names of its groups."""
    groups = member.groupBy("name").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    names = member.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_set("name")), 1, CARRIED).alias("names"))
    dealt = member.join(groups, "name").join(sized, "set_id").join(names, "set_id").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("name", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "set_id", "label", "n", "bits", "names")


def _compare(j: Join):
    def run(key, table):
        group, one_block = key[0].as_py(), key[1].as_py() == key[2].as_py()
        names = table.column("names").combine_chunks()
        ends, flat, earlier = names.offsets.to_numpy(), names.values.to_numpy(), {}

        def before(i: int) -> list[int]:
            """Names of a member's groups that come before this one, of those that it carries."""
            if i not in earlier:
                own = flat[ends[i] : ends[i + 1]]
                earlier[i] = own[: np.searchsorted(own, group)].tolist()
            return earlier[i]

        own, name, label, n = (table.column(c).to_numpy() for c in ("own", "set_id", "label", "n"))
        bits = table.column("bits").to_pylist()
        length = np.array([len(b) for b in bits])
        by_length = {}
        for k in np.unique(length):  # each length also as the longer bitmaps folded to it
            folded = np.zeros((len(bits), k // 8), np.uint64)
            for i in np.flatnonzero(length >= k):
                x = np.frombuffer(bits[i], np.uint64)
                folded[i] = np.bitwise_xor.reduce(x.reshape(-1, k // 8), 0)
            by_length[int(k)] = folded
        out = []
        for i in range(len(bits)):
            other = np.flatnonzero((name > name[i]) & (label != label[i]) & (one_block | (own != own[i])) & (100 * np.minimum(n, n[i]) >= j.percent * np.maximum(n, n[i])))
            for k in np.unique(np.minimum(length[other], length[i])):
                at = other[np.minimum(length[other], length[i]) == k]
                gap = np.bitwise_count(by_length[int(k)][at] ^ by_length[int(k)][i]).sum(1)
                total = n[at] + n[i]
                at = at[gap <= total - 2 * (-(-total * j.percent // (100 + j.percent)))]
                if len(at):
                    mine = set(before(i))
                    at = at[[mine.isdisjoint(before(o)) for o in at.tolist()]]
                out.append(np.stack([np.full(len(at), name[i]), name[at]]))
        x = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(x[0].astype(np.int64)), pa.array(x[1].astype(np.int64))], ["a", "b"])

    return run
