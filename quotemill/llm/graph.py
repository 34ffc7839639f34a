"""Connected components of an edge table, by min-label hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import forget, keep


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): component is the smallest node that links reach.

    Nodes without an edge don't appear. In each step every node of the current graph takes its smallest neighbour's
    label, labels are followed once more, and edges move to the labels; those inside a label go, so the graph shrinks
    fast. All steps are joins and min() aggregates that Spark combines before its shuffle: a node with very many edges
    costs one row for each task. Tables are cut by keep().
    """
    labels, current = None, keep(spark, _between(edges.select("a", "b")), "edges")
    while not current.isEmpty():
        both = current.union(current.select(F.col("b"), F.col("a")))
        near = keep(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "near")
        jump = near.join(near.select(F.col("node").alias("to"), F.col("to").alias("up")), "to").select("node", F.least("to", "up").alias("to"))
        jump = keep(spark, jump, "jump")
        moved = current.join(jump.toDF("a", "x"), "a").join(jump.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        after = keep(spark, _between(moved), "edges")
        old, labels = labels, keep(spark, _compose(labels, jump), "labels")
        forget(spark, current, near, jump, *([old] if old is not None else []))
        current = after
    if labels is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    return labels


def _between(edges: DataFrame) -> DataFrame:
    """Each edge once, from its smaller node; none from a node to itself."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _compose(labels: DataFrame | None, jump: DataFrame) -> DataFrame:
    """First labels, then jump, where it has the label."""
    if labels is None:
        return jump.select("node", F.col("to").alias("component"))
    return labels.join(jump.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def add_links(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components that links(a, b) make of labels(node, component); only links between components cost steps."""
    ends = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    merged = connected_components(spark, ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    fresh = merged.join(labels.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    return keep(spark, _compose(labels, merged.toDF("node", "to")).union(fresh.select("node", "component")), "labels")
