"""Price-history operators: latest rows, as-of rows, segments, first and last prices, keyed writes.

All take and return DataFrames. Ordered picks are aggregates (max_by over a struct), so that Spark combines rows
before the shuffle and no key needs a sort; windows are used only where every row keeps a place of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] | None = None, where: Column | None = None, prefix: str = "") -> DataFrame:
    """For each key the row that is last by ``order`` (of those that ``where`` holds for); one aggregate."""
    names = list(values or [c for c in df.columns if c not in keys])
    row = F.struct(*[F.col(c).alias(f"v_{c}") for c in names])
    place = F.struct(*order)
    picked = F.max_by(row, place) if where is None else F.max_by(F.when(where, row), F.when(where, place))
    return df.groupBy(*keys).agg(picked.alias("row")).select(*keys, *[F.col(f"row.v_{c}").alias(prefix + c) for c in names])


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], broken: Column) -> DataFrame:
    """Rows that don't break the line, with the number of breaks before them (gap and island)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("_broken", F.coalesce(broken, F.lit(False)))
    marked = marked.withColumn("segment", F.sum(F.col("_broken").cast("long")).over(w))
    return marked.where(~F.col("_broken")).drop("_broken")


def first_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, where: Column) -> DataFrame:
    """First and last value in order, their number and the change in percent, over the rows that ``where`` holds for."""
    place = F.struct(*order)
    kept = df.where(where)
    out = kept.groupBy(*keys).agg(F.min_by(value, place).alias("first_value"), F.max_by(value, place).alias("last_value"), F.count("*").alias("points"))
    change = F.when((F.col("points") > 1) & (F.col("first_value") != 0), (F.col("last_value").cast("double") - F.col("first_value").cast("double")) / F.col("first_value").cast("double") * 100)
    return out.withColumn("change", change)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, order: Sequence[str], values: Sequence[str], once: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (ties by ``order``).

    One shuffle of the union by key and a running last value: no range join, so a key's rows are read once. With ``once``
    equal left rows come back as one: the same sort puts them side by side, so no hash table holds them.
    """
    pad = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in order]
    old = left.select(*[F.col(k) for k in keys], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *[p.alias(f"_o{i}") for i, p in enumerate(pad)], F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType).alias("_right"))
    new = right.select(*[F.col(k) for k in keys], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", *[f"_o{i}" for i in range(len(order))], *["_left"] * once)
    both = old.unionByName(new).withColumn("_found", F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if once:
        both = both.withColumn("_again", F.lag("_left").over(w).eqNullSafe(F.col("_left"))).where("not _again")
    both = both.where("_side = 1")
    return both.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in values])


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins by key."""
    return latest(current.unionByName(incoming), keys, order)


def upsert_guarded(rows: DataFrame, keys: Sequence[str], sequence: Sequence[str], success: Column) -> DataFrame:
    """A key's first successful row stays; without one, its last row: successes are never replaced."""
    names = [c for c in rows.columns if c not in keys]
    place, row = F.struct(*sequence), F.struct(*names)
    kept = F.coalesce(F.min_by(F.when(success, row), F.when(success, place)), F.max_by(row, place))
    return rows.groupBy(*keys).agg(kept.alias("r")).select(*keys, "r.*")


def upsert_monotonic(rows: DataFrame, keys: Sequence[str], rank: Column, time: Sequence[str]) -> DataFrame:
    """The row of the highest rank, and of those the newest: older or lower rows never replace it."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(rank.alias("_rank"), *time)).alias("r")).select(*keys, "r.*")


def insert_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of incoming whose key is not there, once for each key (the least row of equals by all columns)."""
    new = incoming.join(current.select(*keys), list(keys), "left_anti")
    names = [c for c in incoming.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min(F.struct(*names)).alias("r")).select(*keys, "r.*") if names else new.distinct()


def failure_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, limit: int) -> DataFrame:
    """Rows at which ``limit`` failures in a row are reached: where a collector stops."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("int"))
    marked = marked.withColumn("_island", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("run_length", F.sum("_f").over(inside))
    return marked.where((F.col("run_length") == limit) & (F.col("_f") == 1)).drop("_f", "_island")
