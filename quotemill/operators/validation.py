"""Validation of imported rows: every row comes back as valid or with its line and error codes, and a file passes whole."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import text as t
from quotemill.session import written

#: Articles longer than this, or addresses longer than that, are refused (fixed values).
ARTICLE, ADDRESS = 150, 2048


def marked(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """rows with ``codes``: in the order of the checks, each of which the condition holds; a null condition does not."""
    return rows.withColumn("codes", F.array_compact(F.array(*[F.when(condition, code) for code, condition in checks.items()])))


def judged(rows: DataFrame, file: str, keys: list[str], line: str) -> DataFrame:
    """rows(file, line, ..., codes) with the code ``repeated`` where a valid row of the same file and keys stands on an earlier
    line, and ``released``: whether no row of the file has a code then. Null keys are equal.

    The rows are read four times here, so they are written first: what they are made of is computed once. Of the keys only
    those with valid rows on several lines are joined, which are few as a rule; their files are not released either.
    """
    rows = written(rows, "rows")
    valid = F.size("codes") == 0
    lines = rows.where(valid).groupBy(file, *keys).agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"))
    again = written(lines.where("last_line > first_line").drop("last_line"), "again")
    names = [file, *keys]
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"_{n}"))
    x = rows.join(again.select(*[F.col(n).alias(f"_{n}") for n in names], "first_line"), same, "left").drop(*[f"_{n}" for n in names])
    repeated = valid & F.coalesce(F.col(line) > F.col("first_line"), F.lit(False))
    x = x.withColumn("codes", F.when(repeated, F.array(F.lit("repeated"))).otherwise(F.col("codes"))).drop("first_line")
    held = rows.where(~valid).select(file).union(again.select(file)).distinct().select(F.col(file).alias("_file"), F.lit(True).alias("_held"))
    return x.join(held, F.col(file).eqNullSafe(F.col("_file")), "left").withColumn("released", F.col("_held").isNull()).drop("_file", "_held")


def validated_tasks(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """tasks(file, line, source, manufacturer, article, product_url, url_template), all texts but line, and
    sources(source, host, label, brand), a row for each brand a source sells -> file, line, source, manufacturer,
    article, url, code, released; a row for each task.

    A source is named by its id, host or label in any case. A brand is matched without punctuation and comes back as
    the source writes it. ``code`` is the first fault: unknown_source, unknown_brand, article, one_address (exactly one
    of address and template), template (exactly one {article}, no other brace), long_address, address (https on the
    source's host or one below it), repeated (same source, brand, article and address as an earlier valid line).
    Null and blank cells are the same. Refused rows keep what could be read. A file is released if no row is refused.
    """
    cell = lambda n: F.trim(F.coalesce(F.col(n), F.lit(""))).alias(n)
    x = tasks.select("file", "line", *[cell(n) for n in ("source", "manufacturer", "article", "product_url", "url_template")])
    named = sources.select("source", "host", F.explode(F.array(F.lower("source"), F.lower("host"), F.lower("label"))).alias("_name")).distinct()
    named = named.groupBy("_name").agg(F.min(F.struct("source", "host")).alias("_s"))
    x = x.join(named, F.lower("source") == F.col("_name"), "left")
    plain = lambda c: F.regexp_replace(t.identity_key(c), r"(?U)[^\w]", "")
    brands = sources.groupBy(F.col("source").alias("_source"), plain(F.col("brand")).alias("_plain")).agg(F.min("brand").alias("_brand"))
    x = x.withColumn("_id", F.col("_s.source")).withColumn("_key", plain(F.col("manufacturer")))
    x = x.join(brands, (F.col("_id") == F.col("_source")) & (F.col("_key") == F.col("_plain")), "left")
    url = F.when(F.col("product_url") != "", F.col("product_url")).otherwise(F.replace(F.col("url_template"), F.lit("{article}"), F.col("article")))
    x = x.withColumn("url", url)
    host = F.lower(F.regexp_extract("url", r"^https://([^/?#:@\s]+)(?:[/?#]|$)", 1))
    left = F.replace(F.col("url_template"), F.lit("{article}"), F.lit(""))
    one = F.length("url_template") - F.length(left) == len("{article}")
    faults = {
        "unknown_source": F.col("_id").isNull(),
        "unknown_brand": F.col("_brand").isNull(),
        "article": (F.col("article") == "") | (F.length("article") > ARTICLE) | F.col("article").rlike(r"[\x00-\x1F]|^[=+@]"),
        "one_address": (F.col("product_url") != "") == (F.col("url_template") != ""),
        "template": (F.col("url_template") != "") & (~one | left.rlike("[{}]")),
        "long_address": F.length("url") > ADDRESS,
        "address": ~((host == F.lower("_s.host")) | host.endswith(F.concat(F.lit("."), F.lower("_s.host")))),
    }
    x = x.select("file", "line", F.coalesce("_id", "source").alias("source"), F.coalesce("_brand", "manufacturer").alias("manufacturer"), "article", "url", F.array_compact(F.array(*[F.when(c, code) for code, c in faults.items()])).alias("codes"))
    return judged(x, "file", ["source", "manufacturer", "article", "url"], "line").select("file", "line", "source", "manufacturer", "article", "url", F.try_element_at("codes", F.lit(1)).alias("code"), "released")


def validated_items(items: DataFrame, runs: DataFrame, competitors: DataFrame) -> DataFrame:
    """items(run, line, competitor, published, precision, basis, url, proof_url, quote, snapshot, status, discovered) and
    runs(run, period, started, finished), times as timestamps, and competitors(competitor) -> run, line, item_id, codes
    (joined by commas, in the order below), released; a row for each item.

    Codes: competitor (not registered), date (text and precision disagree, or no such day), period (dated outside the
    run's), basis (dated without a ground), url, proof (addresses that are no http ones), instant (discovered outside
    the run), status (neither candidate nor verified); of verified items also quote (none), other_page (the proof is of
    another address), snapshot (none), unproven (the snapshot does not hold the quote, white space squeezed); repeated
    (the address is on an earlier valid line of the run). Precision is day, month or unknown; unknown has no date. Items
    of a run that is not there have the code run alone. ``item_id`` is the hash of competitor and address.
    """
    known = competitors.select(F.col("competitor").alias("_competitor")).distinct()
    spans = runs.select(F.col("run").alias("_run"), "period", "started", "finished").dropDuplicates(["_run"])
    x = items.join(spans, F.col("run") == F.col("_run"), "left").join(known, F.col("competitor") == F.col("_competitor"), "left")
    day, month = F.col("published").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr("try_to_date(published, 'yyyy-MM-dd')").isNotNull(), F.col("published").rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    dated = F.when(F.col("precision") == "day", day).when(F.col("precision") == "month", month).when(F.col("precision") == "unknown", F.col("published").isNull())
    verified = F.coalesce(F.col("status") == "verified", F.lit(False))
    page = lambda n: F.lower(F.regexp_replace(F.regexp_replace(F.col(n), "#.*$", ""), "(?<=[^/])/$", ""))
    address = lambda n: ~F.coalesce(F.col(n).rlike(r"^https?://[^/\s]+\S*$"), F.lit(False))
    there = F.col("_run").isNotNull()
    faults = {
        "run": ~there,
        "competitor": there & F.col("_competitor").isNull(),
        "date": there & ~F.coalesce(dated, F.lit(False)),
        "period": there & F.coalesce(dated, F.lit(False)) & (F.left("published", F.lit(7)) != F.col("period")),
        "basis": there & F.coalesce(dated, F.lit(False)) & F.col("published").isNotNull() & (t.squeezed(F.col("basis")) == ""),
        "url": there & address("url"),
        "proof": there & address("proof_url"),
        "instant": there & ~F.coalesce(F.col("discovered").between(F.col("started"), F.col("finished")), F.lit(False)),
        "status": there & ~F.coalesce(F.col("status").isin("candidate", "verified"), F.lit(False)),
        "quote": there & verified & (t.squeezed(F.col("quote")) == ""),
        "other_page": there & verified & ~page("url").eqNullSafe(page("proof_url")),
        "snapshot": there & verified & (F.coalesce("snapshot", F.lit("")) == ""),
        "unproven": there & verified & (F.col("snapshot") != "") & (t.squeezed(F.col("quote")) != "") & ~F.contains(t.squeezed(F.col("snapshot")), t.squeezed(F.col("quote"))),
    }
    x = marked(x.withColumn("item_id", F.sha2(F.concat_ws("\n", "competitor", page("url")), 256)), faults)
    return judged(x.select("run", "line", "item_id", "codes"), "run", ["item_id"], "line").select("run", "line", "item_id", F.array_join("codes", ",").alias("codes"), "released")
