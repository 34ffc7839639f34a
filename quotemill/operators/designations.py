"""Designations decoded by tables: patterns of a maker, what their groups mean, which pairs of groups may stand together.

``Grammar`` holds three tables, so rules are data: rules(rule, maker, pattern, groups); tokens(rule, place, token, field,
number, text, standard, review), where token ``*`` is any and gives the group's own number, and place 0 is true of each
code of the rule; pairs(rule, place, token, place2, token2, field, text), the only pairs that the two places may hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "rule string, maker string, pattern string, groups int"
TOKEN = "rule string, place int, token string, field string, number double, text string, standard boolean, review boolean"
PAIR = "rule string, place int, token string, place2 int, token2 string, field string, text string"

# Two published ordering keys.
RULES = (
    ("pr", "pr", r"^PR(CM|W)?(08|12|18|30)-(1\.5|2|4|5|8|10|15)D(N2|P2|N|P)$", 4),
    ("sis", "sis", r"^SIS-(12|18|30)(V|N)(?:33|55|75)-(NONC|NO|NC)-(PNP|NPN|AC|DC)-(\d+(?:[.,]\d+)?)-(ST|TF)$", 6),
)
TOKENS = (
    *[("pr", 1, *x) for x in (("CM", "connection", "connector"), ("W", "connection", "cable+connector"), ("", "connection", "cable"))],
    *[("pr", 2, *x) for x in (("*", "diameter", None), ("08", "pitch", 1.0), ("12", "pitch", 1.0), ("18", "pitch", 1.0), ("30", "pitch", 1.5))],
    ("pr", 3, "*", "sn", None),
    *[("pr", 4, *x) for x in (("N", "output", "NPN"), ("N2", "output", "NPN"), ("P", "output", "PNP"), ("P2", "output", "PNP"), ("N", "function", "NO"), ("P", "function", "NO"), ("N2", "function", "NC"), ("P2", "function", "NC"))],
    *[("pr", 0, "", *x) for x in (("body_type", "threaded"), ("voltage_type", "DC"), ("load", 200.0), ("ip", "67"))],
    *[("sis", 1, *x) for x in (("*", "diameter", None), ("12", "pitch", 1.0), ("18", "pitch", 1.0), ("30", "review", None))],
    *[("sis", 2, *x) for x in (("V", "mount", "flush"), ("N", "mount", "non-flush"))],
    *[("sis", 3, *x) for x in (("NO", "function", "NO"), ("NC", "function", "NC"), ("NONC", "function", "NO/NC"))],
    *[("sis", 4, *x) for x in (("PNP", "output", "PNP"), ("NPN", "output", "NPN"), ("AC", "output", "2-wire"), ("DC", "output", "2-wire"), ("AC", "voltage_type", "AC"), ("DC", "voltage_type", "DC"), ("PNP", "voltage_type", "DC"), ("NPN", "voltage_type", "DC"))],
    ("sis", 5, "*", "sn", None),
    *[("sis", 6, *x) for x in (("ST", "material", "stainless"), ("TF", "material", "plastic"))],
    ("sis", 0, "", "body_type", "threaded"),
)
PAIRS = (
    *[("pr", 2, size, 3, sn, "mount", "flush") for size, sn in (("08", "1.5"), ("12", "2"), ("18", "5"), ("30", "10"))],
    *[("pr", 2, size, 3, sn, "mount", "non-flush") for size, sn in (("08", "2"), ("12", "4"), ("18", "8"), ("30", "15"))],
)


@dataclass(frozen=True)
class Grammar:
    rules: DataFrame
    tokens: DataFrame
    pairs: DataFrame


def built_in(spark: SparkSession) -> Grammar:
    """The built-in rules; what holds of a whole series is a standard value, a code of unclear pitch is for review."""
    tokens = [(r, p, k, f, v if isinstance(v, float) else None, v if isinstance(v, str) else None, p == 0, f == "review") for r, p, k, f, v in TOKENS]
    return Grammar(spark.createDataFrame(list(RULES), RULE), spark.createDataFrame(tokens, TOKEN), spark.createDataFrame(list(PAIRS), PAIR))


def decoded(codes: DataFrame, by: str, grammar: Grammar) -> DataFrame:
    """codes(by, maker, code) -> by, rule, field, number, text, standard, review; a row for each field that a code gives.

    Codes are folded (upper case, no white space, one kind of dash). A code gives nothing where no pattern of its maker
    fits, or where two places hold a pair that is not listed. ``review`` is true of all fields of a code that holds a
    token for review. Null codes and makers give nothing. Rules meet codes by maker, groups meet tokens by equality.
    """
    folded = F.translate(F.regexp_replace(F.upper("code"), r"(?U)\s+", ""), "–—", "--")
    x = codes.select(by, F.lower("maker").alias("maker"), folded.alias("code")).join(grammar.rules, "maker").where(F.regexp_like("code", F.col("pattern")))
    group = F.expr("transform(sequence(1, groups), i -> regexp_extract(code, pattern, i))")
    x = x.select(by, "rule", "code", F.concat(F.array(F.lit("")), group).alias("held")).distinct()
    places = grammar.pairs.select("rule", "place", "place2").distinct().groupBy("rule").agg(F.collect_list(F.struct("place", "place2")).alias("bound"))  # rules are few
    listed = grammar.pairs.groupBy("rule").agg(F.collect_set(F.concat_ws("|", "place", "token", "place2", "token2")).alias("listed"))
    x = x.join(places.join(listed, "rule"), "rule", "left")
    pair = lambda b: F.concat_ws("|", b["place"], F.get("held", b["place"]), b["place2"], F.get("held", b["place2"]))
    x = x.withColumn("both", F.transform("bound", pair)).where(F.coalesce(F.forall("both", lambda k: F.array_contains("listed", k)), F.lit(True)))
    single = x.select(by, "rule", "code", F.posexplode("held").alias("place", "token"))
    meaning = grammar.tokens.withColumnRenamed("token", "meant")
    j = single.join(meaning, ["rule", "place"]).where((F.col("meant") == F.col("token")) | ((F.col("meant") == "*") & (F.col("token") != "")))
    own = F.translate("token", ",", ".").try_cast("double")
    one = j.select(by, "rule", "code", "field", F.when(F.col("meant") == "*", own).otherwise(F.col("number")).alias("number"), "text", "standard", "review")
    of_pair = grammar.pairs.select("rule", F.concat_ws("|", "place", "token", "place2", "token2").alias("pair"), "field", "text").where("field is not null")
    two = x.select(by, "rule", "code", F.explode("both").alias("pair")).join(of_pair, ["rule", "pair"])
    two = two.select(by, "rule", "code", "field", F.lit(None).cast("double").alias("number"), "text", F.lit(False).alias("standard"), F.lit(False).alias("review"))
    unclear = one.where("review").select(by, "rule", "code", F.lit(True).alias("unclear")).distinct()
    out = one.where("not review").unionByName(two).drop("review").join(unclear, [by, "rule", "code"], "left")
    return out.select(by, "rule", "field", "number", "text", "standard", F.coalesce("unclear", F.lit(False)).alias("review"))


def enriched(cards: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """cards(by, field, number, text, conflict) and decoded() -> by, field, number, text, outcome; a row for each field
    of either.

    conflict: the card contradicts itself, or the designation contradicts the card; no value. confirmed: both say the
    same. card: the card alone, or against a standard value of the series, which yields. filled: the designation alone.
    review: the designation alone, but its code is for review; no value. Two designations of one product that differ
    are a conflict too.
    """
    same = found.groupBy(by, "field").agg(F.min("number").alias("n"), F.max("number").alias("n1"), F.min("text").alias("t"), F.max("text").alias("t1"), F.min("standard").alias("standard"), F.max("review").alias("review"))
    split = F.coalesce(F.col("n") != F.col("n1"), F.lit(False)) | F.coalesce(F.col("t") != F.col("t1"), F.lit(False))
    j = cards.select(by, "field", "number", "text", "conflict").join(same.withColumn("split", split), [by, "field"], "full")
    agrees = F.col("number").eqNullSafe(F.col("n")) & F.col("text").eqNullSafe(F.col("t"))
    said = F.col("standard").isNotNull()
    outcome = (
        F.when(F.col("conflict"), "conflict")
        .when(F.col("conflict").isNotNull() & (~said | (F.col("standard") & ~agrees)), "card")
        .when(F.col("split"), "conflict")
        .when(F.col("conflict").isNotNull(), F.when(agrees, "confirmed").otherwise("conflict"))
        .when(F.col("review"), "review")
        .otherwise("filled")
    )
    j = j.withColumn("outcome", outcome)
    kept = F.col("outcome").isin("card", "confirmed", "filled")
    return j.select(by, "field", F.when(kept, F.coalesce("number", "n")).alias("number"), F.when(kept, F.coalesce("text", "t")).alias("text"), "outcome")
