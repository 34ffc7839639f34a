"""Domain tables over the given star schema: price checks, quotes, products, attributes, source checks, pages.

Each function reads what it needs from ``sf_dir``; SQL holds the same tables for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.session import table


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price check for each event."""
    e, kind, k = table(spark, sf_dir, "events"), F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("obs_id"),
        F.col("user_id").alias("rule_id"),
        F.col("ts").alias("checked_at"),
        F.when(kind == "purchase", "priced").when(kind == "view", "on_request").when(kind == "click", "no_price").when(kind == "signup", "not_found").otherwise("network_error").alias("status"),
        F.when(kind == "purchase", F.col("value").cast("decimal(18,2)")).alias("price"),
        F.when(k % 2 == 0, "RUB").otherwise("USD").alias("currency"),
        F.when(kind == "signup", 404).when(kind == "error", None).otherwise(200).alias("http_status"),
    )


def quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large price history; no unique key."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_partkey").alias("rule_id"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_shipdate").alias("checked_at"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.when(F.col("l_linestatus") == "F", "gross").otherwise("net").alias("basis"),
        F.round(F.col("l_tax") * 100).cast("int").alias("rate"),
        F.when(F.col("l_returnflag") == "A", "priced").when(F.col("l_returnflag") == "N", "on_request").otherwise("no_price").alias("status"),
    )


def rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").cast("decimal(18,2)").alias("list_price"))


def chk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source checks."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    third = F.col("s_suppkey") % 3
    return s.select(
        F.col("s_suppkey").alias("check_id"),
        F.col("n_name").alias("competitor"),
        F.when(third == 0, "news").when(third == 1, "products").otherwise("telegram").alias("kind"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/"), third.cast("string")).alias("url"),
        F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 2000, "partial").otherwise("success").alias("status"),
    )


def attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw name and value pairs; VAT rows carry conflicts."""
    p = table(spark, sf_dir, "part")
    pairs = F.array(
        F.struct(F.lit("Size, mm").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(" mm")).alias("value")),
        F.struct(F.lit("Type").alias("name"), F.col("p_type").alias("value")),
        F.struct(F.lit("Color").alias("name"), F.split("p_name", " ")[0].alias("value")),
    )
    own = p.select(F.col("p_partkey").alias("rule_id"), F.explode(pairs).alias("x")).select("rule_id", "x.name", "x.value")
    t = table(spark, sf_dir, "lineitem")
    vat = t.select(F.col("l_partkey").alias("rule_id"), F.lit("VAT").alias("name"), F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit(" %")).alias("value"))
    return own.unionAll(vat)


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


def post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel"), F.col("turn").alias("post_id"), "role", "text")


#: The same tables as SQL, in the order in which they may build on each other.
SQL = {
    "obs": """select event_id obs_id, user_id rule_id, ts checked_at,
  case event_type when 'purchase' then 'priced' when 'view' then 'on_request' when 'click' then 'no_price' when 'signup' then 'not_found' else 'network_error' end status,
  case when event_type = 'purchase' then cast(value as decimal(18,2)) end price,
  case when cast(json_extract_string(props, '$.k') as int) % 2 = 0 then 'RUB' else 'USD' end currency,
  case event_type when 'signup' then 404 when 'error' then null else 200 end http_status from events""",
    "quote": """select l_partkey rule_id, l_suppkey source_id, l_orderkey run_id, l_linenumber line_no, l_shipdate checked_at,
  cast(l_extendedprice as decimal(18,2)) price, case l_linestatus when 'F' then 'gross' else 'net' end basis, cast(round(l_tax * 100) as int) rate,
  case l_returnflag when 'A' then 'priced' when 'N' then 'on_request' else 'no_price' end status from lineitem""",
    "rule": """select p_partkey rule_id, p_brand manufacturer, p_name title, p_type category, p_size size, cast(p_retailprice as decimal(18,2)) list_price from part""",
    "chk": """select s_suppkey check_id, n_name competitor, case s_suppkey % 3 when 0 then 'news' when 1 then 'products' else 'telegram' end kind,
  'https://' || lower(n_name) || '.example/' || cast(s_suppkey % 3 as varchar) url,
  case when s_acctbal < 0 then 'error' when s_acctbal < 2000 then 'partial' else 'success' end status from supplier join nation on s_nationkey = n_nationkey""",
    "attr": """select p_partkey rule_id, name, value from part, lateral (values ('Size, mm', p_size || ' mm'), ('Type', p_type), ('Color', split_part(p_name, ' ', 1))) s(name, value)
  union all select l_partkey, 'VAT', cast(round(l_tax * 100) as int) || ' %' from lineitem""",
    "page": "select page_id, url, html from pages",
    "doc": "select doc_id, text, lang, source, n_chars, quality, toxic from documents left join labels using (doc_id)",
    "post": "select conv_id channel, turn post_id, role, text from conversations",
}
