"""Token ids as binary files: canonical length-limited Huffman codes, in independent blocks.

The file format is a folder of two tables, so that any store Spark can write will do:
 codes   id, length: the code lengths; canonical codes follow from them.
 blocks  part, block: order; start: ids of all documents before it; documents, sizes: their ids (int64) and their
         numbers of token ids (int64); payload: the bits, most significant first; checkpoints: the bit offset (int64)
         of every STEPth token id. A block holds whole documents and is decoded by itself.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import tokens
from quotemill.llm.common import keep, rows, shared_dir, shuffle_partitions

STEP, LIMIT = 256, 16
#: Stands for a null doc_id in a block's documents.
NO_ID = -(2**63)


@dataclass(frozen=True)
class Format:
    tokenizer: str | None = None
    end_id: int = 2
    #: A block ends with the document that takes it to so many ids.
    block_ids: int = 65_536


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code of at most limit bits (package-merge); 0 where the count is 0. The limit is
    raised to a bit more than the number of ids needs."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, (len(used) - 1).bit_length() + 1)  # more ids than codes of that length: longer codes
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    leaf_first, current = [], weight
    flags = np.ones(len(weight), bool)
    for _ in range(limit):
        leaf_first.append(flags)
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        current, flags = both[order], order < len(weight)
    take, lengths = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for flags in reversed(leaf_first):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = lengths
    return out


def longest(lengths: np.ndarray) -> int:
    """Bits that the decoding table looks at."""
    return max(LIMIT, int(lengths.max(initial=0)))


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    limit = longest(lengths)
    codes, order = np.zeros(len(lengths), np.int64), np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    step = np.int64(1) << (limit - lengths[order])
    codes[order] = (np.cumsum(step) - step) >> (limit - lengths[order])
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all values of the next bits, as many as the longest code has: the id whose code they begin with, and the
    code's length."""
    limit = longest(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.int64(1) << (limit - lengths[order])
    pad = (1 << limit) - int(span.sum())
    return np.concatenate([np.repeat(order, span), np.zeros(pad, np.int64)]).astype(np.int32), np.concatenate([np.repeat(lengths[order], span), np.ones(pad, np.int64)])


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and the bit offset of every STEPth."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids]
    end = np.cumsum(size)
    at = end - size
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros((int(end[-1]) >> 5) + 2, np.uint64)
    out[word[first]] = np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8], at[::STEP].copy()


def decode_ids(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """blocks: (payload, checkpoints, number of ids). All stretches between checkpoints are decoded side by side."""
    symbol, size = table
    limit = len(symbol).bit_length() - 1
    base, words, lanes, left = 0, [], [], []
    for payload, checkpoints, n in blocks:
        w = np.frombuffer(payload + b"\0" * (-len(payload) % 4 + 4), ">u4").astype(np.uint64)
        words.append(w)
        lanes.append(checkpoints + base)
        left.append(np.minimum(STEP, n - STEP * np.arange(len(checkpoints))))
        base += 32 * len(w)
    if not lanes or not sum(map(len, lanes)):
        return [np.zeros(0, np.int32) for _ in blocks]
    w = np.concatenate(words)
    pair = (w << np.uint64(32)) | np.append(w[1:], np.uint64(0))
    at, left = np.concatenate(lanes), np.concatenate(left)
    out = np.zeros((STEP, len(at)), np.int32)
    for i in range(int(left.max())):
        bits = (pair[at >> 5] >> (64 - limit - (at & 31)).astype(np.uint64)).astype(np.int64) & ((1 << limit) - 1)
        out[i] = symbol[bits]
        at = np.minimum(at + size[bits], base - 33)
    flat = out.T
    keep_, ends = np.arange(STEP)[None, :] < left[:, None], np.cumsum([len(x) for x in lanes])
    return [flat[a:b][keep_[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


#: A row for each document; after those of a part one row with its counts of ids, which alone has that column.
TOKENS = "part int, doc_id bigint, start bigint, ids binary, counts binary"


def _tokenize(f: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = tokens.encoder(f.tokenizer or tokens.default_path()), TaskContext.get().partitionId(), 0
        total = np.zeros(encoder.tokenizer.get_vocab_size() + 1, np.int64)
        for batch in rows(batches, 1024):
            ids = [np.append(x, np.int32(f.end_id)) for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            ends = start + np.cumsum([len(x) for x in ids])
            seen = np.bincount(np.concatenate(ids), minlength=len(total))
            total = seen + np.pad(total, (0, len(seen) - len(total)))
            kind = np.uint16 if max(int(x.max()) for x in ids) < 65_536 else np.int32
            blobs = [bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column("doc_id"), pa.array(ends - [len(x) for x in ids]), pa.array(blobs, pa.binary()), pa.nulls(len(ids), pa.binary())], ["part", "doc_id", "start", "ids", "counts"])
            start = int(ends[-1])
        used = np.flatnonzero(total)
        last = [pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([start], pa.int64()), pa.array([None], pa.binary()), pa.array([np.concatenate([used, total[used]]).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, ["part", "doc_id", "start", "ids", "counts"])

    return run


def stored_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint16 if blob[0] == 2 else np.int32, offset=1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("counts").to_pylist():
            used, n = np.frombuffer(blob, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n)], ["id", "n"])


BLOCKS = "part int, block int, start bigint, documents binary, sizes binary, n_ids bigint, payload binary, checkpoints binary"


def _encode(f: Format, code, offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.drop_encoders()
        lengths = code.value
        codes = canonical_codes(lengths)
        held: list[tuple[int, np.ndarray]] = []
        part, start, number, size = None, 0, 0, 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            payload, checkpoints = encode_ids(ids, codes, lengths)
            row = [part, number, start, np.array([d for d, _ in held], np.int64).tobytes(), np.array([len(x) for _, x in held], np.int64).tobytes(), len(ids), payload, checkpoints.astype(np.int64).tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in rows(batches):
            for p, doc_id, at, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "start", "ids")), strict=True):
                at += offsets[p]
                if held and (p != part or at != start + size or size >= f.block_ids):
                    yield out()
                    number, held = (number + 1 if p == part else 0), []
                if not held:
                    part, start, size = p, at, 0
                held.append((doc_id, stored_ids(blob)))
                size += len(held[-1][1])
        if held:
            yield out()

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, fmt: Format = Format()) -> None:
    """docs(doc_id, text, ...) -> files at path, in ascending order of doc_id (ties by text; null ids first).

    Null text: empty, so the end id alone; a null doc_id comes back as null. Repeated rows are all written. More columns
    are ignored.
    """
    parts = shuffle_partitions(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ids = keep(spark, ranged.mapInArrow(_tokenize(fmt), TOKENS), "ids")
    counts = ids.select("counts").where("counts is not null").mapInArrow(_counts, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary
    total = np.zeros(int(max(counts.column("id").to_numpy(), default=0)) + 1, np.int64)
    total[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    lengths = code_lengths(total)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    offsets, at = {}, 0
    for row in sorted(ids.where("counts is not null").select("part", "start").collect()):  # a row for each part
        offsets[row["part"]] = at
        at += row["start"]
    ids.where("counts is null").select("part", "doc_id", "start", "ids").mapInArrow(_encode(fmt, spark.sparkContext.broadcast(lengths), offsets), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
#: Blocks that are decoded at once.
BLOCKS_AT_ONCE = 8


def _decode(lengths, with_ids: bool):
    names = [c.split()[0] for c in READ.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.drop_encoders()
        table = decode_table(lengths.value)
        for batch in rows(batches, BLOCKS_AT_ONCE):
            columns = [batch.column(c).to_pylist() for c in ("start", "documents", "sizes", "n_ids", "payload", "checkpoints")]
            ids = decode_ids([(p, np.frombuffer(c, np.int64), n) for n, p, c in zip(*columns[3:], strict=True)], table)
            out: list[tuple] = []
            for start, documents, sizes, x in zip(*columns[:3], ids, strict=True):
                sizes = np.frombuffer(sizes, np.int64)
                ends, data = np.cumsum(sizes), memoryview(x.astype("<u4").tobytes())
                for doc_id, n, end in zip(np.frombuffer(documents, np.int64).tolist(), sizes.tolist(), ends.tolist(), strict=True):
                    own = data[4 * (end - n) : 4 * end]
                    out.append((None if doc_id == NO_ID else doc_id, start + end - n, n, zlib.crc32(own), *([bytes(own)] if with_ids else [])))
            kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Files of write_tokens() -> doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit integers). Without
    ids they are decoded all the same, and stay in the task."""
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    lengths = np.zeros(int(max(codes.column("id").to_numpy(), default=0)) + 1, np.int64)
    lengths[codes.column("id").to_numpy()] = codes.column("length").to_numpy()
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_decode(spark.sparkContext.broadcast(lengths), with_ids), READ + ", ids binary" * with_ids)


def token_digests(spark: SparkSession, docs: DataFrame, fmt: Format = Format(), with_ids: bool = True) -> DataFrame:
    """Writes docs to a new folder beside the checkpoints and reads them back."""
    path = f"{shared_dir(spark)}/quotemill-{uuid.uuid4().hex}/tokens"
    write_tokens(spark, docs, path, fmt)
    return read_tokens(spark, path, with_ids)
