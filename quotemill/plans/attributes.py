"""Queries over raw product attributes: dictionaries, typed values, designations, enrichment, labels, scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import attributes as a
from quotemill.functions import prices
from quotemill.functions import text as t
from quotemill.operators import checks
from quotemill.sources.views import attr, obs, post, quote, rule

#: Attribute names as keys, and the fields they are; then fields of names that begin so (fixed values).
ALIASES = (("size, mm", "size"), ("diameter", "size"), ("type", "kind"), ("body", "kind"), ("color", "material"), ("vat", "rate"))
PREFIXES = (("size (", "size"), ("vat rate", "rate"))
#: Patterns of kinds and of what a title names (fixed values).
KINDS = {"economy": "econom", "standard": "standard", "promo": "promo", "small": "small", "medium": "medium", "large": "large"}
STEMS = {"widget": "widget", "gadget": "gadget", "gear": "gear", "ring": "ring", "bolt": "bolt"}
STATUS_LABELS = {"priced": "Price shown", "on_request": "On request", "no_price": "No price", "not_found": "Page not found"}
METRIC_LABELS = {"listPrice": "List price", "size": "Size, mm"}


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Attributes with names as different sites write them."""
    k, name = F.col("rule_id") % 4, F.col("name")
    noisy = F.when((name == "Size, mm") & (k == 1), " SIZE,  mm:").when((name == "Size, mm") & (k == 2), "Size (outer), mm").when((name == "Type") & (k == 1), "Body ").when((name == "VAT") & (k == 3), "VAT rate, percent").when((name == "Color") & (k == 2), "Colour").otherwise(name)
    return attr(spark, d).select("rule_id", noisy.alias("name"), "value")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Raw attributes with their field, null where no dictionary knows the name."""
    raw = _raw(spark, d).withColumn("key", t.attribute_key(F.col("name")))
    alias = spark.createDataFrame(list(ALIASES), "key string, field string")
    begins = F.when(F.lit(False), "")
    for prefix, field in PREFIXES:
        begins = begins.when(F.col("key").startswith(prefix), field)
    return raw.join(F.broadcast(alias), "key", "left").withColumn("field", F.coalesce("field", begins))  # a fixed dictionary


def jo22_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Raw attribute names by the field they stand for."""
    return _fields(spark, d).groupBy(F.coalesce("field", F.lit("unknown")).alias("field"), "key").agg(F.count("*").alias("n"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    x, v = _fields(spark, d).where("field is not null"), F.col("value")
    parsed = F.when(F.col("field").isin("size", "rate"), a.single_number(v).cast("int").cast("string")).when(F.col("field") == "kind", F.coalesce(a.first_of(v, KINDS), F.lower(v))).otherwise(F.lower(v))
    return checks.consensus(x.select("rule_id", "field", parsed.alias("value")), ["rule_id", "field"], "value")


def co6_normalized(spark: SparkSession, d: str) -> DataFrame:
    """One row for each product with its typed, agreed fields and its number of conflicting ones."""
    x = _typed(spark, d)
    wide = x.groupBy("rule_id").pivot("field", ["size", "kind", "material", "rate"]).agg(F.first("value"))
    conflicts = x.groupBy("rule_id").agg(F.count_if("conflict").alias("conflicts"))
    return wide.join(conflicts, "rule_id").select("rule_id", F.col("size").cast("int").alias("size"), "kind", "material", F.col("rate").cast("int").alias("rate"), "conflicts")


def co7_audit(spark: SparkSession, d: str) -> DataFrame:
    """By brand: products, those with each field, complete ones, conflicts, and the share that is complete."""
    x = rule(spark, d).select("rule_id", "manufacturer").join(co6_normalized(spark, d), "rule_id", "left")
    whole = F.col("size").isNotNull() & F.col("kind").isNotNull() & F.col("material").isNotNull() & F.col("rate").isNotNull()
    out = x.groupBy("manufacturer").agg(F.count("*").alias("products"), F.count("size").alias("with_size"), F.count("kind").alias("with_kind"), F.count("material").alias("with_material"), F.count("rate").alias("with_rate"), F.count_if(whole).alias("complete"), F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"))
    return out.withColumn("share", F.round(F.try_divide("complete", "products") * 100, 4))


def fn1_identity(spark: SparkSession, d: str) -> DataFrame:
    """Products whose identity is written differently but is the same: brand and title with other dashes and spaces."""
    r, k = rule(spark, d), F.col("rule_id") % 3
    written = F.when(k == 0, F.concat_ws("—", "manufacturer", "title")).when(k == 1, F.concat(F.lit("  "), F.concat_ws(" ‑ ", "manufacturer", "title"))).otherwise(F.concat_ws("-", F.upper("manufacturer"), "title"))
    return r.groupBy(t.identity_key(written).alias("identity")).agg(F.count("*").alias("n"))


def fn2_attribute_keys(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).groupBy(t.attribute_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("spellings"))


def fn3_model_keys(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).groupBy(t.model_key(F.concat_ws(" – ", "title", F.col("size").cast("string"))).alias("model_key")).agg(F.count("*").alias("n"), F.min("rule_id").alias("first_id"))


def fn4_squeezed(spark: SparkSession, d: str) -> DataFrame:
    return post(spark, d).select("channel", "post_id", F.length(t.squeezed(F.col("text"))).cast("long").alias("chars"))


def fn5_whole_token(spark: SparkSession, d: str) -> DataFrame:
    """Products whose written title holds ``ring`` as a token of its own, not within a word or a dashed code."""
    written = F.when(F.col("rule_id") % 3 == 0, F.concat("title", F.lit("-ring"))).when(F.col("rule_id") % 3 == 1, F.concat("title", F.lit(" ring."))).otherwise(F.col("title"))
    return rule(spark, d).where(a.whole_token(written, "ring")).select("rule_id")


def fn6_latin_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes written with Cyrillic letters meet those with Latin ones."""
    r = rule(spark, d)
    code = F.concat(F.when(F.col("rule_id") % 2 == 0, "СМР").otherwise("cmp"), F.col("size").cast("string"))
    return r.groupBy(t.latin_designation(code).alias("code")).agg(F.count("*").alias("n"))


def fn7_labels(spark: SparkSession, d: str) -> DataFrame:
    """brand · title · category where it differs from the title's first word · source."""
    first = F.upper(F.split("title", " ")[0])
    return rule(spark, d).select("rule_id", F.concat_ws(" · ", "manufacturer", "title", F.when(F.upper("category") != first, F.col("category")), F.concat(F.lit("part "), F.col("rule_id").cast("string"))).alias("label"))


def fn11_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every reason for which a check is no success, in words."""
    codes = F.array_compact(F.array(F.when(F.col("status") == "network_error", "network error"), F.when(F.col("http_status") >= 400, "page not found"), F.when(F.col("http_status").isNull(), "no answer"), F.when((F.col("status") == "priced") & (F.col("currency") != "RUB"), "other currency")))
    return obs(spark, d).groupBy(F.array_join(codes, "; ").alias("reasons")).agg(F.count("*").alias("n"))


def fn12_mojibake(spark: SparkSession, d: str) -> DataFrame:
    """Posts read in a wrong encoding are found by their corruption score."""
    broken = F.when(F.col("post_id") % 3 == 0, F.concat("text", F.lit(" Ð\u0094Ð°Ñ\u0082Ñ\u0087Ð¸Ðº"))).otherwise(F.col("text"))
    score = a.corruption(broken)
    return post(spark, d).groupBy(score.cast("long").alias("score")).agg(F.count("*").alias("n"))


def fn14_file_tokens(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).select("rule_id", t.file_token(F.concat_ws(" / ", "manufacturer", "title", F.lit("№1")), 24).alias("token"))


def fn16_numbers(spark: SparkSession, d: str) -> DataFrame:
    """One number, or a signed range, read from texts; anything else is refused."""
    r, k = rule(spark, d), F.col("rule_id")
    low, high = -25 - k % 3 * 10, 60 + k % 2 * 10
    ranged = F.concat(low.cast("string"), F.lit("...+"), high.cast("string"), F.lit(" °C"))
    x = a.interval(F.when(k % 5 == 0, F.lit("+70 °C")).otherwise(ranged))
    one = a.single_number(F.when(k % 4 == 0, F.concat_ws("x", F.lit("M18"), F.lit("1"))).otherwise(F.concat(F.lit("Ø "), F.col("size").cast("string"), F.lit(",5 mm"))))
    return r.select("rule_id", one.alias("number"), x["low"].alias("low"), x["high"].alias("high"))


def fn17_units(spark: SparkSession, d: str) -> DataFrame:
    """Currents in mA and frequencies in Hz."""
    r, k = rule(spark, d), F.col("rule_id")
    load = F.when(k % 3 == 0, F.concat(F.col("size").cast("string"), F.lit(" mA"))).when(k % 3 == 1, F.concat(F.col("size").cast("string"), F.lit(" A"))).otherwise(F.concat(F.lit("5...1"), F.col("size").cast("string"), F.lit(" мА")))
    rate = F.when(k % 2 == 0, F.concat(F.col("size").cast("string"), F.lit(" kHz"))).otherwise(F.concat(F.col("size").cast("string"), F.lit(" Гц")))
    return r.select("rule_id", a.milliamperes(load).alias("ma"), a.hertz(rate).alias("hz"))


def fn18_positive(spark: SparkSession, d: str) -> DataFrame:
    r, k = rule(spark, d), F.col("rule_id") % 5
    written = F.when(k == 0, F.lit("NaN")).when(k == 1, F.concat(F.lit("-"), F.col("size").cast("string"))).when(k == 2, F.lit("1e400")).when(k == 3, F.lit("abc")).otherwise(F.col("list_price").cast("string"))
    return r.select("rule_id", a.positive(written).alias("price"))


def fn20_display(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).select("rule_id", a.display_money(F.col("list_price") * 1000).alias("shown"))


def fn21_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds as texts name them, in the order of the rules."""
    return rule(spark, d).groupBy(a.first_of(F.concat_ws(" ", "category", "title"), KINDS).alias("kind")).agg(F.count("*").alias("n"))


def fn22_family(spark: SparkSession, d: str) -> DataFrame:
    """The family that a title names; several stems name none, and a stated family overrides."""
    written = F.when(F.col("rule_id") % 4 == 0, F.concat("title", F.lit(" gadget widget"))).otherwise(F.col("title"))
    stated = F.when(F.col("rule_id") % 10 == 0, "stated")
    return rule(spark, d).select("rule_id", F.coalesce(stated, a.one_of(written, STEMS)).alias("family"))


def fn23_availability(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("status") == "priced", "В наличии").when(F.col("status") == "on_request", "Под заказ, 3 дня").when(F.col("status") == "no_price", "Нет в наличии").when(F.col("status") == "not_found", "Снят с производства; в наличии аналог").otherwise("")
    return obs(spark, d).groupBy(prices.availability(text).alias("availability")).agg(F.count("*").alias("n"))


def fn26_comparable(spark: SparkSession, d: str) -> DataFrame:
    """Which last net and gross quotes of a product may be compared: same known unit and basis, rates that agree."""
    q = quote(spark, d).where("status = 'priced'")
    unit = F.when(F.col("source_id") % 3 == 0, "piece").when(F.col("source_id") % 3 == 1, "pack").otherwise("unknown")
    by = q.groupBy("rule_id", "line_no").agg(F.max_by(F.struct(unit.alias("unit"), "basis", "rate"), F.struct("checked_at", "run_id", "source_id", "price", "basis", "rate")).alias("x"))
    one, two = by.where("line_no = 1").select("rule_id", F.col("x").alias("own")), by.where("line_no = 2").select("rule_id", F.col("x").alias("other"))
    return one.join(two, "rule_id").select("rule_id", prices.comparable("own", "other").alias("comparable"))


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    """Designations of a brand's products by the rules of that brand, a row for each field. Tokens outside a rule's
    dictionary give nothing, and a code that breaks its pattern gives no field at all."""
    r, k = rule(spark, d), F.col("rule_id")
    code = F.concat(F.element_at(F.array(*map(F.lit, ("I", "C", "O", "Z"))), (k % 4 + 1).cast("int")), F.lit("-"), F.col("size").cast("string"), F.when(k % 5 == 0, "X").otherwise(F.when(k % 2 == 0, "N").otherwise("P")), F.when(k % 9 == 0, "?").otherwise(""))
    rules = spark.createDataFrame([("Brand#1", r"^([A-Z])-(\d+)([NPX])$", 1, "function", "I=inductive;C=capacitive;O=optical"), ("Brand#1", r"^([A-Z])-(\d+)([NPX])$", 3, "output", "N=npn;P=pnp"), ("Brand#1", r"^([A-Z])-(\d+)([NPX])$", 2, "size", ""), ("Brand#2", r"^[A-Z]-(\d+)([NPX])$", 1, "size", ""), ("Brand#2", r"^[A-Z]-(\d+)([NPX])$", 2, "output", "N=pnp;P=npn")], "maker string, pattern string, place int, field string, tokens string")
    x = r.select("rule_id", F.left("manufacturer", F.lit(7)).alias("maker"), code.alias("code")).join(F.broadcast(rules), "maker")  # fixed rules
    token = F.nullif(F.expr("regexp_extract(code, pattern, place)"), F.lit(""))
    return x.select("rule_id", "code", "field", F.when(F.col("tokens") == "", token).otherwise(F.try_element_at(F.str_to_map("tokens", F.lit(";"), F.lit("=")), token)).alias("value")).where("value is not null")


def fn28_designations(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d).select("rule_id", "code", "field", "value")


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    """Decoded sizes against those of the cards: conflicts stay, gaps are filled, equal ones are confirmed."""
    card = rule(spark, d).select("rule_id", F.when(F.col("rule_id") % 3 != 0, F.when(F.col("rule_id") % 8 == 1, F.col("size") + 1).otherwise(F.col("size")).cast("string")).alias("card"))
    x = _decoded(spark, d).where("field = 'size'").select("rule_id", F.col("value").alias("decoded")).join(card, "rule_id")
    outcome = F.when(F.col("card").isNull(), "filled").when(F.col("card") == F.col("decoded"), "confirmed").otherwise("conflict")
    return x.select("rule_id", F.when(outcome != "conflict", F.coalesce("card", "decoded")).alias("value"), outcome.alias("outcome"))


def fn29_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d)


def fn30_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Where the sizes of products come from."""
    source = F.when(F.col("outcome") == "filled", "designation").when(F.col("outcome") == "confirmed", "card and designation").otherwise("contradiction of card and designation")
    return _enriched(spark, d).groupBy(source.alias("source")).agg(F.count("*").alias("n"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.create_map(F.lit("listPrice"), F.col("list_price").cast("string"), F.lit("size"), F.when(F.col("rule_id") % 4 != 0, F.col("size").cast("string")), F.lit("openOrders"), F.when(F.col("rule_id") % 2 == 0, F.lit("")).otherwise(F.lit("0")))
    return rule(spark, d).select("rule_id", F.explode(pairs).alias("key", "value"))


def fn10_metric_labels(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).groupBy(a.metric_label(F.col("key"), METRIC_LABELS).alias("label")).agg(F.count("*").alias("n"))


def fn46_metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row for each metric: nothing is unknown, and that isn't zero."""
    flag = F.when(F.col("value").isNull(), "unknown").when(F.col("value") == "", "stale").otherwise("actual")
    return _metrics(spark, d).select("rule_id", a.metric_label(F.col("key"), METRIC_LABELS).alias("label"), F.coalesce(F.nullif("value", F.lit("")), F.lit("—")).alias("shown"), flag.alias("flag"))


def fn48_brand_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Of each product's list of attributes only those of some names."""
    lists = attr(spark, d).groupBy("rule_id").agg(F.collect_set(F.struct("name", "value")).alias("attributes"))
    kept = F.filter("attributes", lambda x: F.lower(x["name"]).isin("type", "color"))
    return lists.select("rule_id", F.array_join(F.array_sort(F.transform(kept, lambda x: x["value"])), ", ").alias("kept"))


def fn49_attribute_lists(spark: SparkSession, d: str) -> DataFrame:
    """Attribute lists without repeated pairs: how many went."""
    lists = attr(spark, d).groupBy("rule_id").agg(F.collect_list(F.struct("name", "value")).alias("x"))
    return lists.select("rule_id", F.size(F.array_distinct("x")).cast("long").alias("kept"), (F.size("x") - F.size(F.array_distinct("x"))).cast("long").alias("gone"))


def fn62_status_labels(spark: SparkSession, d: str) -> DataFrame:
    """Statuses by label; one without a label shows its code."""
    return obs(spark, d).groupBy(a.label_of(F.col("status"), STATUS_LABELS).alias("label")).agg(F.count("*").alias("n"))


def fn63_execution(spark: SparkSession, d: str) -> DataFrame:
    """Products by what they are and do, the unknown shown as such."""
    x = rule(spark, d)
    signature = F.concat_ws(" · ", F.coalesce(a.one_of(F.col("title"), STEMS), F.lit("?")), F.coalesce(F.when(F.col("rule_id") % 7 != 0, F.lower("category")), F.lit("?")), F.coalesce(F.when(F.col("rule_id") % 5 != 0, F.col("size").cast("string")), F.lit("?")))
    return x.groupBy(signature.alias("signature")).agg(F.count("*").alias("n"))


def fn64_scope(spark: SparkSession, d: str) -> DataFrame:
    """Whether a product's attributes name its brand: confirmed, excluded by another one, or unverified."""
    stated = F.when(F.col("rule_id") % 3 == 0, F.concat(F.lit("maker: "), F.col("manufacturer"))).when(F.col("rule_id") % 3 == 1, F.lit("maker: Other"))
    name = F.nullif(F.regexp_extract(stated, r"^maker: (.+)$", 1), F.lit(""))
    state = F.when(name.isNull(), "unverified").when(F.lower(name) == F.lower("manufacturer"), "confirmed").otherwise("excluded")
    return rule(spark, d).groupBy("manufacturer", state.alias("state")).agg(F.count("*").alias("n"))


def fn65_brand_keys(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of a brand meet under the key without punctuation and case."""
    written = F.when(F.col("rule_id") % 2 == 0, F.upper("manufacturer")).otherwise(F.concat(F.regexp_replace("manufacturer", "#", " - "), F.lit(".")))
    key = F.lower(F.regexp_replace(written, r"(?U)[^\w]", ""))
    return rule(spark, d).groupBy(key.alias("brand_key")).agg(F.count_distinct(written).alias("spellings"), F.count("*").alias("n"))


def fn66_fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of fetches, and which of them are failures of the source."""
    code = F.when(F.col("obs_id") % 17 == 0, 429).when(F.col("obs_id") % 19 == 0, 403).otherwise(F.col("http_status"))
    outcome = F.when(code.isNull(), "network_error").when(code.isin(401, 403), "blocked").when(code == 429, "rate_limited").when(code.isin(404, 410), "not_found").when(code >= 500, "server_error").otherwise("loaded")
    x = obs(spark, d).select(outcome.alias("outcome"))
    return x.groupBy("outcome", F.col("outcome").isin("network_error", "blocked", "rate_limited", "server_error").alias("source_failure")).agg(F.count("*").alias("n"))


def se4_token_union(spark: SparkSession, d: str) -> DataFrame:
    """Sorted union of the tokens of a title and of the category."""
    both = F.array_sort(F.array_union(F.split(F.lower("title"), " "), F.split(F.lower("category"), " ")))
    return rule(spark, d).groupBy(F.array_join(both, " ").alias("tokens")).agg(F.count("*").alias("n"))


def se5_containment(spark: SparkSession, d: str) -> DataFrame:
    """Products whose rates hold all rates of the brand's first product."""
    rates = quote(spark, d).groupBy("rule_id").agg(F.collect_set("rate").alias("rates"))
    r = rule(spark, d).select("rule_id", "manufacturer").join(rates, "rule_id")
    first = r.groupBy("manufacturer").agg(F.min_by("rates", "rule_id").alias("wanted"))
    return r.join(first, "manufacturer").where(F.size(F.array_except("wanted", "rates")) == 0).select("rule_id")


def se7_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Every name by which a product is asked for: title, category, both also behind the brand."""
    names = F.array("title", "category", F.concat_ws(" ", "manufacturer", "title"), F.concat_ws(" ", "manufacturer", "category"))
    return rule(spark, d).select("rule_id", F.explode(F.transform(names, F.lower)).alias("alias")).distinct().groupBy("alias").agg(F.count("*").alias("products"))


def fi4_facets(spark: SparkSession, d: str) -> DataFrame:
    """Products for which every criterion is known and equal; what is unknown never matches."""
    x = co6_normalized(spark, d)
    return x.where((F.col("size") < 25) & (F.col("material") != "cold")).select("rule_id", "size", "material")


def li7_option_order(spark: SparkSession, d: str) -> DataFrame:
    """Options of a facet with their places: numbers by value, then texts."""
    shown = F.when(F.col("size") % 5 == 0, F.concat(F.lit("ca. "), F.col("size").cast("string"))).otherwise(F.col("size").cast("string"))
    options = rule(spark, d).select(shown.alias("option")).distinct()
    number = F.col("option").try_cast("double")
    return options.select("option", F.row_number().over(Window.orderBy(number.isNull(), number, "option")).cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (jo22_dictionary, co6_normalized, co7_audit, fn1_identity, fn2_attribute_keys, fn3_model_keys, fn4_squeezed, fn5_whole_token, fn6_latin_codes, fn7_labels, fn10_metric_labels, fn11_reasons, fn12_mojibake, fn14_file_tokens, fn16_numbers, fn17_units, fn18_positive, fn20_display, fn21_kinds, fn22_family, fn23_availability, fn26_comparable, fn28_designations, fn29_enrichment, fn30_provenance, fn46_metric_rows, fn48_brand_attributes, fn49_attribute_lists, fn62_status_labels, fn63_execution, fn64_scope, fn65_brand_keys, fn66_fetch_outcomes, se4_token_union, se5_containment, se7_aliases, fi4_facets, li7_option_order)}

_FIELD = "case when name = 'Size, mm' then 'size' when name = 'Type' then 'kind' when name = 'Color' and rule_id % 4 <> 2 then 'material' when name = 'VAT' then 'rate' end"
_KEY = "case when name = 'Size, mm' and rule_id % 4 = 2 then 'size (outer), mm' when name = 'Type' and rule_id % 4 = 1 then 'body' when name = 'VAT' and rule_id % 4 = 3 then 'vat rate, percent' when name = 'Color' and rule_id % 4 = 2 then 'colour' else lower(name) end"
_KIND = "case " + " ".join(f"when contains(lower({{0}}), '{p}') then '{k}'" for k, p in KINDS.items()) + " end"
_NORMAL = f"v as (select rule_id, {_FIELD} f, case when name in ('Size, mm', 'VAT') then regexp_extract(value, '[0-9]+') when name = 'Type' then coalesce({_KIND.format('value')}, lower(value)) else lower(value) end x from attr), w as (select rule_id, f, case when count(distinct x) = 1 then min(x) end x, count(distinct x) > 1 c from v where f is not null group by 1, 2), n as (select rule_id, (min(x) filter (f = 'size'))::int size, min(x) filter (f = 'kind') kind, min(x) filter (f = 'material') material, (min(x) filter (f = 'rate'))::int rate, count_if(c) conflicts from w group by 1)"
_CODE = "c as (select *, substr('ICOZ', (rule_id % 4 + 1)::int, 1) t, case when rule_id % 5 = 0 then 'X' when rule_id % 2 = 0 then 'N' else 'P' end o, left(manufacturer, 7) m from rule), x as (select *, t || '-' || size || o as code from c where rule_id % 9 <> 0 and m in ('Brand#1', 'Brand#2'))"
_SIZES = f"{_CODE}, y as (select rule_id, size::varchar decoded, case when rule_id % 3 <> 0 then (size + (rule_id % 8 = 1)::int)::varchar end card from x), e as (select rule_id, case when card is null then decoded when card = decoded then card end as value, case when card is null then 'filled' when card = decoded then 'confirmed' else 'conflict' end outcome from y)"
_STEM = "list_filter([" + ", ".join(f"case when contains({{0}}, '{p}') then '{k}' end" for k, p in STEMS.items()) + "], lambda z: z is not null)"
_METRICS = "m as (select rule_id, 'List price' as label, list_price::varchar as value from rule union all select rule_id, 'Size, mm', case when rule_id % 4 <> 0 then size::varchar end from rule union all select rule_id, 'Open orders', case when rule_id % 2 = 0 then '' else '0' end from rule)"
_LAST_OF = "(select rule_id, arg_max({'u': case source_id % 3 when 0 then 'piece' when 1 then 'pack' else 'unknown' end, 'b': basis, 'r': rate}, (checked_at, run_id, source_id, price, basis, rate)) x from quote where status = 'priced' and line_no = @ group by 1)"
SQL = {
    "jo22_dictionary": f"select coalesce({_FIELD}, 'unknown') as field, {_KEY} as key, count(*) n from attr group by 1, 2",
    "co6_normalized": f"with {_NORMAL} select * from n",
    "co7_audit": f"with {_NORMAL} select manufacturer, count(*) products, count(n.size) with_size, count(kind) with_kind, count(material) with_material, count(rate) with_rate, count_if(n.size is not null and kind is not null and material is not null and rate is not null) complete, coalesce(sum(conflicts), 0)::bigint conflicts, round(complete / products * 100, 4) as share from rule left join n using (rule_id) group by 1",
    "fn1_identity": "select upper(case rule_id % 3 when 1 then manufacturer || ' - ' || title else manufacturer || '-' || title end) as identity, count(*) n from rule group by 1",
    "fn2_attribute_keys": f"select {_KEY} as key, count(*) n, count(distinct case when name = 'Size, mm' and rule_id % 4 = 1 then ' SIZE' else name end) spellings from attr group by 1",
    "fn3_model_keys": "select upper(replace(title, ' ', '')) || '-' || size model_key, count(*) n, min(rule_id) first_id from rule group by 1",
    "fn4_squeezed": r"select channel, post_id, length(trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x85\p{Z}]+', ' ', 'g'))) chars from post",
    "fn5_whole_token": r"select rule_id from rule where regexp_matches(case rule_id % 3 when 0 then title || '-ring' when 1 then title || ' ring.' else title end, '(^|[^\w-])ring($|[^\w-])')",
    "fn6_latin_codes": "select 'CMP' || size as code, count(*) n from rule group by 1",
    "fn7_labels": "select rule_id, concat_ws(' · ', manufacturer, title, case when upper(category) <> upper(split_part(title, ' ', 1)) then category end, 'part ' || rule_id) as label from rule",
    "fn10_metric_labels": f"with {_METRICS} select label, count(*) n from m group by 1",
    "fn11_reasons": "select concat_ws('; ', case when status = 'network_error' then 'network error' end, case when http_status >= 400 then 'page not found' end, case when http_status is null then 'no answer' end, case when status = 'priced' and currency <> 'RUB' then 'other currency' end) reasons, count(*) n from obs group by 1",
    "fn12_mojibake": r"select len(regexp_extract_all(case when post_id % 3 = 0 then text || ' Ð' || chr(148) || 'Ð°Ñ' || chr(130) || 'Ñ' || chr(135) || 'Ð¸Ðº' else text end, '[ÃÂÐÑ][\x{80}-\x{BF}]|\x{FFFD}')) score, count(*) n from post group by 1",
    "fn14_file_tokens": "select rule_id, left(regexp_replace(manufacturer || ' / ' || title || ' / №1', '[^A-Za-z0-9._-]+', '_', 'g'), 24) token from rule",
    "fn16_numbers": "select rule_id, case when rule_id % 4 <> 0 then size + 0.5 end number, case when rule_id % 5 <> 0 then -25 - rule_id % 3 * 10 end::double low, case when rule_id % 5 <> 0 then 60 + rule_id % 2 * 10 end::double high from rule",
    "fn17_units": "select rule_id, (case rule_id % 3 when 0 then size when 1 then size * 1000 else ('1' || size)::int end)::double ma, (case when rule_id % 2 = 0 then size * 1000 else size end)::double hz from rule",
    "fn18_positive": "select rule_id, case when rule_id % 5 = 4 then list_price::double end price from rule",
    "fn20_display": "select rule_id, translate(format('{:,.2f}', (list_price * 1000)::double), ',.', ' ,') shown from rule",
    "fn21_kinds": "select " + _KIND.format("category || ' ' || title") + " kind, count(*) n from rule group by 1",
    "fn22_family": "with t as (select rule_id, case when rule_id % 4 = 0 then title || ' gadget widget' else title end w from rule) select rule_id, case when rule_id % 10 = 0 then 'stated' when len(" + _STEM.format("w") + ") = 1 then " + _STEM.format("w") + "[1] end family from t",
    "fn23_availability": "select case status when 'priced' then 'in_stock' when 'on_request' then 'on_order' when 'no_price' then 'out_of_stock' when 'not_found' then 'discontinued' else 'unknown' end availability, count(*) n from obs group by 1",
    "fn26_comparable": f"select a.rule_id, a.x.u <> 'unknown' and a.x.u = b.x.u and a.x.b = b.x.b and a.x.r = b.x.r comparable from {_LAST_OF.replace('@', '1')} a join {_LAST_OF.replace('@', '2')} b using (rule_id)",
    "fn28_designations": f"with {_CODE} select rule_id, code, 'size' as field, size::varchar as value from x union all select rule_id, code, 'function', case t when 'I' then 'inductive' when 'C' then 'capacitive' else 'optical' end from x where m = 'Brand#1' and t <> 'Z' union all select rule_id, code, 'output', case when (o = 'N') = (m = 'Brand#1') then 'npn' else 'pnp' end from x where o <> 'X'",
    "fn29_enrichment": f"with {_SIZES} select * from e",
    "fn30_provenance": f"with {_SIZES} select case outcome when 'filled' then 'designation' when 'confirmed' then 'card and designation' else 'contradiction of card and designation' end as source, count(*) n from e group by 1",
    "fn46_metric_rows": f"with {_METRICS} select rule_id, label, coalesce(nullif(value, ''), '—') shown, case when value is null then 'unknown' when value = '' then 'stale' else 'actual' end flag from m",
    "fn48_brand_attributes": "select rule_id, coalesce(string_agg(distinct value, ', ' order by value) filter (name in ('Type', 'Color')), '') kept from attr group by 1",
    "fn49_attribute_lists": "select rule_id, count(distinct (name, value)) kept, count(*) - count(distinct (name, value)) gone from attr group by 1",
    "fn62_status_labels": "select case status when 'priced' then 'Price shown' when 'on_request' then 'On request' when 'no_price' then 'No price' when 'not_found' then 'Page not found' else status end as label, count(*) n from obs group by 1",
    "fn63_execution": "select concat_ws(' · ', case when len(" + _STEM.format("title") + ") = 1 then " + _STEM.format("title") + "[1] else '?' end, case when rule_id % 7 <> 0 then lower(category) else '?' end, case when rule_id % 5 <> 0 then size::varchar else '?' end) signature, count(*) n from rule group by 1",
    "fn64_scope": "select manufacturer, case rule_id % 3 when 0 then 'confirmed' when 1 then 'excluded' else 'unverified' end state, count(*) n from rule group by 1, 2",
    "fn65_brand_keys": "select lower(replace(manufacturer, '#', '')) brand_key, count(distinct rule_id % 2) spellings, count(*) n from rule group by 1",
    "fn66_fetch_outcomes": "with t as (select case when obs_id % 17 = 0 then 429 when obs_id % 19 = 0 then 403 else http_status end c from obs) select case when c is null then 'network_error' when c = 403 then 'blocked' when c = 429 then 'rate_limited' when c = 404 then 'not_found' else 'loaded' end outcome, (c is null or c in (403, 429)) source_failure, count(*) n from t group by 1, 2",
    "se4_token_union": "select array_to_string(list_sort(list_distinct(string_split(lower(title), ' ') || string_split(lower(category), ' '))), ' ') tokens, count(*) n from rule group by 1",
    "se5_containment": "with r as (select rule_id, list(distinct rate) s from quote group by 1), j as (select rule_id, manufacturer, s from rule join r using (rule_id)), f as (select manufacturer, arg_min(s, rule_id) w from j group by 1) select rule_id from j join f using (manufacturer) where list_has_all(s, w)",
    "se7_aliases": "with t as (select rule_id, unnest([title, category, manufacturer || ' ' || title, manufacturer || ' ' || category]) n from rule) select lower(n) as alias, count(distinct rule_id) products from t group by 1",
    "fi4_facets": f"with {_NORMAL} select rule_id, size, material from n where size < 25 and material <> 'cold'",
    "li7_option_order": "with o as (select distinct case when size % 5 = 0 then 'ca. ' || size else size::varchar end as option from rule) select option, row_number() over (order by try_cast(option as double) is null, try_cast(option as double), option) place from o",
}
