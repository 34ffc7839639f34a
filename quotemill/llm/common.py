"""What the operators of this subpackage share: a folder that all executors see, and hash helpers."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers of a 64-bit finalizer (fixed values).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests), a new local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows that keep() hands to Python at once: whole texts, of which Spark's 10,000 fill the memory of both sides.
BATCH_ROWS = 2048


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/quotemill-{uuid.uuid4().hex}/{tag}"
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(spark: SparkSession, df: DataFrame, tag: str, column: str) -> DataFrame:
    """keep(), in as many buckets of the column as the session shuffles into, so that what groups by it later reads its rows
    without a shuffle. The table's name goes from the catalog at once; its files stay."""
    name = f"quotemill_{uuid.uuid4().hex}_{tag}"
    path = f"{shared_dir(spark)}/quotemill-{uuid.uuid4().hex}/{tag}"
    df.write.format("parquet").bucketBy(shuffle_partitions(spark), column).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the name goes
    spark.sql(f"drop table {name}")
    return out


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by keep() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quotemill-" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path.getParent(), True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key() -> F.Column:
    """A hash of doc_id and text, by which a row is known: rows that share a doc_id have their own, and so have rows
    without one. Null texts are empty."""
    doc_id = F.col("doc_id").cast("long")
    return F.xxhash64(doc_id.isNull(), F.coalesce(doc_id, F.lit(0).cast("long")), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def crc_mod(column: str, n: int) -> F.Column:
    """crc32(column as text) mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def py_crc_mod(value: int, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def rows(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[pa.RecordBatch]:
    """Small batches, so that Python objects of few rows live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; cleared when it has grown to a fixed number of words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multiplier of the shingle polynomial (a fixed value).
POLY = 0x9E3779B97F4A7C15


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the size-word shingles; fewer words: the whole sequence as one."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    p, h = np.uint64(POLY), np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        h = h * p + hashes[i : n - width + 1 + i]
    if n < size:
        h += np.uint64(n)
    return np.unique(mix64(h))


def parted(p: np.ndarray, kind: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (p, kind, blob), one for each part: its slice of every column, behind each other."""
    order = np.argsort(p, kind="stable")
    uniq, start = np.unique(p[order], return_index=True)
    end = np.append(start[1:], len(p))
    columns = [c[order] for c in columns]
    for at in range(0, len(uniq), 64):
        blobs = [b"".join([c[a:b].tobytes() for c in columns]) for a, b in zip(start[at : at + 64], end[at : at + 64], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(uniq[at : at + 64].astype(np.int32)), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], ["p", "kind", "blob"])


def maybe_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df with a column ``likely``: false only where ids(column) does not hold the row's value.

    A bitmap of 2^23 hash slots, at most 256 rows of 4 KB, is broadcast; it keeps most other rows out of a join's shuffle.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(1 << 23))
    bits = ids.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))
    out = df.withColumn("slot", slot).withColumn("bucket", F.expr("bitmap_bucket_number(slot)")).join(F.broadcast(bits), "bucket", "left")
    byte = "cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(slot) div 8 + 1 as int), 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce(({byte} & shiftleft(1, cast(bitmap_bit_position(slot) % 8 as int))) <> 0, false)")
    return out.withColumn("likely", hit).drop("slot", "bucket", "bitmap")
