"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. A row is known by its
doc_id and text together, so rows that share a doc_id are judged each. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import keep, row_key
from quotemill.llm.decontaminate import decontaminate
from quotemill.llm.jaccard_join import first_rows
from quotemill.llm.packing import pack_documents
from quotemill.llm.quality_rules import quality_rules
from quotemill.llm.suffix_dedup import cut_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("key", row_key())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    keyed = _keyed(docs)
    judged = quality_rules(spark, keyed.select(F.col("key").alias("doc_id"), "text", "lang"))
    passed = keep(spark, judged.where("kept").select(F.col("doc_id").alias("key")), "passed")
    return keyed.join(passed, "key", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with similar shingle sets, the row of the smallest doc_id (null last) and key stays."""
    keyed = _keyed(docs)
    stays = keep(spark, first_rows(spark, keyed), "stays")
    out = keyed.join(stays.select("key"), "key", "left_semi")
    if not stays.where("n > 1").isEmpty():
        out = out.dropDuplicates(["key"])  # rows that are there twice
    return out.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that are found elsewhere too go from the texts."""
    return cut_repeats(spark, docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate(spark, docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in sequences."""
    return pack_documents(spark, docs)[0]


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("suffix_dedup", repeated_passages), ("decontaminate", benchmark_free), ("packing", packed)]

#: Perplexity, components, suffixes and the tokenizer are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = keep(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
