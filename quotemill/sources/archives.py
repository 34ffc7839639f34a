"""Archives of delimited files of many shapes: one long table of attributes, and an inventory of the files.

Files are read by lines, not whole: a file's encoding, separator and header are small aggregates of its lines, and a
quoted cell that spans lines is joined again by the parity of quotes. A row that holds a whole row in one quoted cell is
unwrapped; rows of another shape than their header, without a name, or of no known brand are counted and left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.sources.files import cells, read_records

#: Columns that are no attributes (fixed values).
SERVICE = ("name", "price", "info", "link", "is_available")
ARTICLE = "Артикул"
#: What a title without a brand says before the model (fixed values).
KINDS = ("Индуктивный датчик", "Датчик индуктивный", "Датчик бесконтактный", "Выключатель индуктивный")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-zа-я0-9]", "")


def judged_records(records: DataFrame, fixed: Mapping[str, str], brands: Sequence[str], source: Column) -> DataFrame:
    """Data records with their cells by header, brand, article and state: accepted, rejected_shape, without_name or
    outside_brand_scope. The brand is that of the source's prefix, else the first of ``brands`` whose name is in the title.
    """
    count = lambda s: F.length("text") - F.length(F.replace("text", F.lit(s), F.lit("")))
    head = records.where("record = 1").withColumn("sep", F.when(count(";") > count(","), ";").otherwise(","))
    head = head.select("file", "sep", cells(F.col("text"), F.col("sep")).alias("header"))
    rows = records.where("record > 1").join(head, "file").withColumn("flat", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(cells(F.col("text"), F.col("sep"))))
    nested = F.when((F.size("flat") == 1) & (F.size("header") > 1), cells(F.col("flat")[0], F.col("sep")))
    rows = rows.withColumn("nested", nested).withColumn("unwrapped", F.coalesce(F.size("nested") == F.size("header"), F.lit(False)))
    rows = rows.withColumn("values", F.when(F.col("unwrapped"), F.col("nested")).otherwise(F.col("flat")))
    pairs = F.filter(F.zip_with("header", "values", lambda k, v: F.struct(F.rtrim(F.trim(k), F.lit(":")).alias("name"), v.alias("value"))), lambda p: F.trim(p["value"]) != "")
    shaped = F.size("values") == F.size("header")
    rows = rows.withColumn("source", source).withColumn("pairs", F.when(shaped, pairs))

    def cell(name: str) -> Column:
        return F.try_element_at(F.filter("pairs", lambda p: p["name"] == name), F.lit(-1))["value"]

    title = cell("name")
    brand = F.lit(None).cast("string")
    for prefix, name in fixed.items():
        brand = F.coalesce(brand, F.when(F.startswith("source", F.lit(prefix)), name))
    listed = F.array(*[F.struct(F.lit(b).alias("brand"), compact(F.lit(b)).alias("key")) for b in brands])
    # the title is bound before the brands are tried: a filter that Spark pushes down has it as an expression over the record
    first = F.transform(F.array(compact(title)), lambda t: F.try_element_at(F.filter(listed, lambda b: F.contains(t, b["key"])), F.lit(1)))
    brand = F.coalesce(brand, first[0]["brand"])
    rows = rows.withColumn("title", title).withColumn("brand", brand)
    at = F.expr("locate(lower(brand), lower(title))")
    after = F.when(at > 0, F.regexp_replace(F.substr("title", at + F.length("brand")), r"(?U)^\s+|\s+$", "")).otherwise(F.col("title"))
    after = F.regexp_replace(after, rf"(?iu)^(?:{'|'.join(KINDS)})\s+", "")
    article = F.coalesce(F.when(cell(ARTICLE) != F.col("title"), cell(ARTICLE)), after)
    state = F.when(~shaped, "rejected_shape").when(F.col("title").isNull(), "without_name").when(F.col("brand").isNull(), "outside_brand_scope").otherwise("accepted")
    return rows.select("file", "encoding", "source", F.col("record").alias("line"), "unwrapped", F.size("header").alias("columns"), state.alias("state"), "brand", article.alias("article"), "title", cell("link").alias("product_url"), "pairs")


def attributes(judged: DataFrame) -> DataFrame:
    """(file, source, line, brand, article, title, product_url, name, value) of accepted records, a row for each attribute."""
    named = F.filter("pairs", lambda p: ~p["name"].isin(*SERVICE))
    return judged.where("state = 'accepted'").select("file", "source", "line", "brand", "article", "title", "product_url", F.inline(named))


def inventory(spark: SparkSession, path: str, records: DataFrame, judged: DataFrame, pattern: str = "*.csv") -> DataFrame:
    """Every file with its hash, encoding, number of columns and of records by state; files without records have zeros."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    # the hash is taken where the file is read; its bytes are not shuffled
    files = files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))
    known = records.groupBy("file").agg(F.first("encoding").alias("encoding"))
    counts = judged.groupBy("file").agg(F.max("columns").alias("columns"), F.count_if("unwrapped").alias("unwrapped"), *[F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "rejected_shape", "without_name", "outside_brand_scope")])
    return files.join(known, "file", "left").join(counts, "file", "left").fillna(0)
