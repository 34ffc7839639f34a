"""Grids, differences, consensus and set operators over catalogue and source tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], content: Column, declared: int | None = None) -> DataFrame:
    """Keys that were added or changed; what is gone is not reported. With a declared total that new does not reach,
    nothing is: an incomplete snapshot proves nothing."""
    a, b = old.select(*keys, content.alias("_old"), F.lit(True).alias("_in_old")), new.select(*keys, content.alias("_new"))
    both = b.join(a, list(keys), "left")
    change = F.when(F.col("_in_old").isNull(), "added").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    out = both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())
    if declared is None:
        return out
    return out.where(F.lit(new.count() == declared))


def completeness_grid(config: DataFrame, checks: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], missing: dict[str, str]) -> DataFrame:
    """Every configured key with the values of its last check, or what stands for none."""
    last = checks.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return config.join(last, list(keys), "left").select(*config.columns, *[F.coalesce(F.col(f"_v.{v}"), F.lit(missing.get(v))).alias(v) for v in values])


def consensus(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value where all rows that have one agree; null and a conflict flag where they don't."""
    out = df.groupBy(*keys).agg(F.min(value).alias("_least"), F.max(value).alias("_most"), F.count(value).alias("sightings"))
    return out.select(*keys, F.when(F.col("_least") == F.col("_most"), F.col("_least")).alias(value), F.coalesce(F.col("_least") != F.col("_most"), F.lit(False)).alias("conflict"), "sightings")


def resolve(wanted: DataFrame, catalogue: DataFrame, key: str, target: str, line: str | None = None) -> DataFrame:
    """exact with the only match, ambiguous, or missing; where lines are given, a key on a later line again is a duplicate."""
    known = catalogue.groupBy(key).agg(F.count_distinct(target).alias("_n"), F.min(target).alias("_t"))
    repeated = F.lit(False)
    if line:
        first = wanted.groupBy(key).agg(F.min(line).alias("_first"))
        wanted, repeated = wanted.join(first, key), F.col(line) > F.col("_first")
    state = F.when(repeated, "duplicate").when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "exact").otherwise("ambiguous")
    return wanted.join(known, key, "left").select(*[c for c in wanted.columns if c != "_first"], state.alias("state"), F.when((F.col("_n") == 1) & ~repeated, F.col("_t")).alias(target))


def shares(df: DataFrame, bucket: str, buckets: Sequence[str]) -> DataFrame:
    """Rows and share of each bucket, zero rows included; other values count as ``other``."""
    named = F.when(F.col(bucket).isin(*buckets), F.col(bucket)).otherwise("other")
    counts = df.groupBy(named.alias(bucket)).agg(F.count("*").alias("n"))
    everything = counts.groupBy().pivot(bucket, [*buckets, "other"]).agg(F.sum("n"))
    rows = F.array(*[F.struct(F.lit(b).alias(bucket), F.coalesce(F.col(b), F.lit(0)).alias("n")) for b in [*buckets, "other"]])
    total = reduce(lambda x, y: x + y, [F.coalesce(F.col(b), F.lit(0)) for b in [*buckets, "other"]])
    return everything.select(F.explode(rows).alias("x"), total.alias("total")).select(f"x.{bucket}", "x.n", F.round(F.try_divide(F.col("x.n"), F.col("total")), 6).alias("share"))


def ordered_union(parts: Sequence[DataFrame], key: str, position: str) -> DataFrame:
    """Distinct keys of all parts in the order in which they first came."""
    stacked = reduce(DataFrame.unionByName, [p.select(key, F.struct(F.lit(i).alias("part"), F.col(position).alias("at")).alias("_p")) for i, p in enumerate(parts)])
    return stacked.groupBy(key).agg(F.min("_p").alias("_p")).select(key, F.col("_p.part").alias("part"), F.col("_p.at").alias("at"))
