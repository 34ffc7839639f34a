"""File sources and sinks: delimited task files, archives of tables, safe exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.text import safe_cell


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], aliases: Mapping[str, str] | None = None, separators: str = ";,\t") -> DataFrame:
    """Delimited files, one row for each record with its file, record number (blank ones count) and error code.

    Files are UTF-8, or else Windows-1251; a quoted cell may hold separators, line breaks and doubled quotes. The separator
    is the one that the header holds most often. Headers are matched without case, aliases apply; an unknown or a repeated
    header rejects the file. A line with more values than headers is rejected; blank lines go.
    """
    names = {c.lower(): c for c in columns} | {k.lower(): v for k, v in (aliases or {}).items()}
    lines = read_records(spark, path).withColumn("text", F.trim("text"))
    header = F.col("text")
    chosen = F.array_max(F.array(*[F.struct((F.length(header) - F.length(F.replace(header, F.lit(s), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(separators)]))["s"]
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    heads = lines.where("record = 1").withColumn("sep", chosen)
    heads = heads.select("file", "sep", F.transform(cells(F.col("text"), F.col("sep")), lambda h: F.try_element_at(known, F.lower(F.trim(h)))).alias("header"))
    bad_header = F.when(F.exists("header", lambda h: h.isNull()), "unknown_header").when(F.size(F.array_distinct("header")) < F.size("header"), "duplicate_header")
    rows = lines.where("record > 1 and text <> ''").join(heads.withColumn("bad", bad_header), "file")
    rows = rows.withColumn("values", cells(F.col("text"), F.col("sep")))
    error = F.coalesce("bad", F.when(F.size("values") > F.size("header"), "value_without_header"))

    def value(name: str) -> Column:
        at = F.array_position("header", F.lit(name)).cast("int")
        return F.when(F.col("bad").isNull() & (at > 0), F.nullif(F.trim(F.get("values", at - 1)), F.lit("")))

    return rows.select("file", F.col("record").cast("int").alias("line"), error.alias("error"), *[value(c).alias(c) for c in columns])


def read_records(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, record, text, encoding) of all files below a folder, read by lines; record 1 is the header, blank lines are
    records too. A quoted cell that spans lines is joined again by the parity of quotes.

    A file is UTF-8 if all its lines are, else Windows-1251. Lines are ordered by their block and their place in it. A quote
    mark that is no cell's border must be doubled: alone it opens a quoted cell.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"))
    utf8 = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"))
    lines = lines.join(utf8, "file")
    cyrillic = F.pandas_udf(_cyrillic, "string")
    known = lines.where("utf8").withColumn("text", F.col("raw").cast("string"))
    other = lines.where("not utf8").withColumn("text", cyrillic("raw"))
    lines = known.unionByName(other).select("file", "block", "at", F.when(F.col("utf8"), "utf-8").otherwise("cp1251").alias("encoding"), F.regexp_replace("text", "^﻿", "").alias("text"))
    of_file = Window.partitionBy("file").orderBy("block", "at")
    quotes = F.coalesce(F.sum(F.regexp_count("text", F.lit('"'))).over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("opens", (quotes % 2 == 0).cast("int")).withColumn("n", F.row_number().over(of_file))
    lines = lines.withColumn("record", F.sum("opens").over(of_file.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("file", "record", "encoding").agg(joined.alias("text"))


def _cyrillic(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("cp1251", "replace"))


def cells(line: Column, sep: Column) -> Column:
    """The cells of a line; quotes around a cell go, doubled ones inside it are one."""
    quoted = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    pattern = F.concat(quoted, F.lit('(?:"(?:[^"]|"")*"|(?:(?!'), quoted, F.lit(").)*)"))
    found = F.regexp_extract_all(F.concat(sep, line), pattern, F.lit(0))
    bare = F.transform(found, lambda x: F.trim(F.substr(x, F.lit(2))))
    return F.transform(bare, lambda x: F.when(x.rlike('(?s)^".*"$'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


#: Lines of a file that export_csv() writes, at most.
FILE_LINES = 10_000


def export_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated files of at most FILE_LINES lines in which no text cell is a formula."""
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    df.select(*[safe_cell(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns]).write.option("maxRecordsPerFile", FILE_LINES).csv(path, sep=";", header=True, escape='"')
