"""Queries over products: attribute consensus, analogue matching, tax-aware price comparison, analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import prices
from quotemill.operators import checks, history, matching
from quotemill.plans.history import QUOTE_ORDER
from quotemill.session import dealt, table, written
from quotemill.sources.views import attr, quote, rule


def sensors(spark: SparkSession, d: str) -> DataFrame:
    """Products with typed characteristics; some are unknown on purpose."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    body = F.length("p_type") % 3
    return p.select(
        k.alias("id"),
        F.col("p_brand").alias("brand"),
        F.lit("inductive").alias("family"),
        F.when(k % 7 != 0, F.when(body == 0, "threaded").when(body == 1, "smooth").otherwise("rect")).alias("body_type"),
        F.when(F.expr("p_partkey div 100 % 5 <> 3"), F.col("p_size")).alias("diameter"),
        F.split("p_name", " ")[1].alias("output"),
        F.when(k % 13 != 0, k % 4).alias("sn"),
        (-25 - k % 3 * 10).alias("tmin"),
        (60 + k % 2 * 10).alias("tmax"),
        F.when(k % 17 != 0, F.split("p_name", " ")[0]).alias("material"),
        (100 + k % 3 * 100).alias("load"),
        (F.col("p_size") + k % 3).alias("length"),
        F.when(k % 11 == 0, 4).otherwise(3).alias("wire_count"),
    )


SENSORS_SQL = """s as (select p_partkey id, p_brand brand, case when p_partkey % 7 <> 0 then case length(p_type) % 3 when 0 then 'threaded' when 1 then 'smooth' else 'rect' end end body_type,
  case when p_partkey // 100 % 5 <> 3 then p_size end diameter, split_part(p_name, ' ', 2) as output, case when p_partkey % 13 <> 0 then p_partkey % 4 end sn, -25 - p_partkey % 3 * 10 tmin, 60 + p_partkey % 2 * 10 tmax,
  case when p_partkey % 17 <> 0 then split_part(p_name, ' ', 1) end material, 100 + p_partkey % 3 * 100 as load, p_size + p_partkey % 3 as length, case when p_partkey % 11 = 0 then 4 else 3 end wire_count from part)"""


#: What the evaluation reads of a product.
FIELDS = ["family", "body_type", "diameter", "output", "sn", "tmin", "tmax", "material", "load", "wire_count"]


def _row(side: str, columns: list[str]) -> F.Column:
    return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns])


def jo11_wildcard_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every hundredth product: equal body and diameter, unknown matching everything; by anchor.
    Products of one body, diameter and brand are counted before they meet the anchors."""
    s = sensors(spark, d)
    classes = s.groupBy("body_type", "diameter", "brand").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    met = matching.wildcard_blocks(classes, s.where("id % 100 = 0").select("id", "body_type", "diameter", "brand"), ["body_type", "diameter"]).where("l.brand <> r.brand")
    return met.groupBy(F.col("r.id").alias("anchor")).agg(F.sum("l.n").alias("candidates"), F.sum("l.ids").alias("id_sum"))


#: Groups of equal products are cut into so many, so that none is whole in one row or one task.
CUTS = 16


def co1_analogues(spark: SparkSession, d: str) -> DataFrame:
    """Status of every candidate of the anchors, its differences, reserves and missing mandatory fields. Products that are
    equal in what is compared are evaluated once for an anchor, which then meets each."""
    s, keys = sensors(spark, d), ["body_type", "diameter"]
    anchors = s.where("id % 100 = 0 and brand is not null")
    alike = matching.blinded(anchors, s.where("brand is not null"), keys).withColumn("_cut", F.pmod(F.xxhash64("id"), F.lit(CUTS)).cast("int"))
    alike = alike.repartition(4 * matching.SALTS, "_known", *FIELDS, "_cut").groupBy("_known", *FIELDS, "_cut", "brand").agg(F.collect_list("id").alias("ids"))
    alike = alike.groupBy("_known", *FIELDS, "_cut").agg(F.collect_list(F.struct("brand", "ids")).alias("brands")).withColumns({f"_{k}": matching.tag(k) for k in keys})
    on = ["_known", "_cut", "_body_type", "_diameter"]
    meets = matching.met_by(anchors, keys).withColumn("_cut", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))))
    for k in keys:
        meets = meets.withColumn(f"_{k}", F.explode(f"_{k}"))
    sides = [x.repartition(4 * matching.SALTS, *on) for x in (alike, meets)]
    met = sides[0].alias("r").join(sides[1].alias("l").hint("shuffle_hash"), on)
    e = matching.evaluate(met.select(_row("l", ["id", "brand", *FIELDS]).alias("l"), _row("r", FIELDS).alias("r"), "brands"))
    differences = sum((F.when(F.col(c) == "difference", 1).otherwise(0) for c in e.columns if c.startswith("o_")), F.lit(0))
    found = ["status", "differences", "reserves", "missing_mandatory"]
    each = e.withColumn("differences", differences.cast("long")).select(F.col("l.id").alias("anchor"), F.col("l.brand").alias("own"), *found, F.explode("brands").alias("b")).where("own <> b.brand")
    return each.select("anchor", F.explode("b.ids").alias("candidate"), *found)


EQUAL = ["body_type", "diameter", "output"]


def co18_match_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A row for each field of the direct and close matches: both values and the outcome."""
    known = sensors(spark, d).dropna(subset=EQUAL)  # a direct or close match has all mandatory fields, and equal
    anchors, others = (x.repartition(matching.SALTS, *EQUAL) for x in (known.where("id % 100 = 0"), known))
    same = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in EQUAL])
    met = others.alias("r").join(anchors.alias("l").hint("shuffle_hash"), same & (F.col("l.brand") != F.col("r.brand")))
    pairs = met.select(*[F.struct(*[F.col(f"{x}.{c}") for c in known.columns]).alias(x) for x in "lr"])
    chosen = matching.evaluate(pairs).where(F.col("status").isin("direct", "close")).select("l", "r")
    return chosen.select(F.col("l.id").alias("anchor"), F.col("r.id").alias("chosen"), F.explode(matching.evidence(chosen)).alias("f")).select("anchor", "chosen", "f.field", F.col("f.group").alias("kind"), "f.reference", "f.candidate", "f.outcome")


RISK = ["r0", "r1", "r2", "r3", "r4"]


#: What a kind and an anchor that meet have in common (tags); a point of an anchor and a brand.
PLACE = ["_known", "_diameter", "_output", "_length"]
POINT = [*PLACE, "anchor", "brand", "rank", *RISK]
KIND = ["_kind", "_known", *FIELDS]
STATUSES = ["direct", "close", "review"]
#: Tasks that the pairs are made in.
TASKS = 128


class _Candidates:
    """Every hundredth product against the candidates of other brands in which what the anchor knows of diameter and output
    is known too. It is equal then, else the candidate is incompatible, so other pairs are not made.

    Candidates that differ in brand, length and id only are one kind, which is evaluated once for an anchor; it holds, for
    each brand, the lengths nearest to the anchor's. Both are dealt by what must be equal, so that all points of an
    anchor come up in one task: no pair is shuffled. ``ids``: how many of the least ids of a brand and length are held.
    """

    def __init__(self, spark: SparkSession, d: str, ids: int):
        products = sensors(spark, d).where("brand is not null")
        anchors = products.where("id % 100 = 0")
        self.seen = matching.blinded(anchors, products, ["body_type"], ["diameter", "output"]).withColumn("_kind", F.xxhash64("_known", *FIELDS)).select(*KIND, "brand", "length", "id")
        each = dealt(self.seen, "_kind", "brand")
        if ids:
            first = F.row_number().over(Window.partitionBy(*KIND, "brand", "length").orderBy("id"))
            each = each.withColumn("_k", first).where(F.col("_k") <= ids).groupBy(*KIND, "brand", "length").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        else:
            each = each.select(*KIND, "brand", "length").distinct().withColumn("ids", F.array().cast("array<bigint>"))
        kinds = each.groupBy(*KIND, "brand").agg(F.collect_list(F.struct("length", "ids")).alias("lengths"))
        self.kinds = written(kinds.withColumns({f"_{k}": matching.tag(k) for k in ("body_type", "diameter", "output")}), "kinds")
        met = matching.met_by(anchors.withColumnRenamed("brand", "own"), ["body_type"], ["diameter", "output"])
        self.anchors = met.withColumn("_length", matching.tag("length"))

    def near(self, top: int | None) -> DataFrame:
        """The kinds for each length that an anchor has: for each brand the 2 * top nearest lengths (all, without top), which are
        at least ``top`` different gaps, and how many candidates are not among them."""
        gap = lambda x: F.coalesce(F.abs(x["length"] - F.col("of")).cast("double"), F.lit(float("inf")))
        held = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.size(x["ids"]))
        near = F.sort_array(F.transform("lengths", lambda x: F.struct(gap(x).alias("gap"), x["length"].alias("length"), x["ids"].alias("ids"))))
        met = self.kinds.join(self.anchors.select(*PLACE, F.col("length").alias("of")).distinct(), PLACE[:-1]).withColumn("near", near)
        if top:
            met = met.withColumn("near", F.when(F.col("of").isNull(), F.col("near")).otherwise(F.slice("near", 1, 2 * top)))  # to an unknown length all are alike
        brands = F.collect_list(F.struct("brand", "near", (held("lengths") - held("near")).alias("lost")))
        return written(met.groupBy(*PLACE, "_body_type", "_kind", *FIELDS).agg(brands.alias("brands")), "near")

    def evaluated(self, near: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        """POINT without the gap, missing, reserves, near, lost and the kind: a row for each anchor, kind and brand.
        asked(anchor, ...): these anchors only, and what else is asked."""
        anchors = self.anchors if asked is None else self.anchors.join(asked.withColumnRenamed("anchor", "id"), "id")
        more = asked.drop("anchor").columns if asked is not None else []
        sides = [x.repartition(TASKS, *PLACE) for x in (near, anchors)]
        # the body is no key of the join, so the pairs lie by PLACE
        met = sides[0].alias("r").join(sides[1].alias("l").hint("shuffle_hash"), PLACE).where(F.array_contains(F.col("l._body_type"), F.col("r._body_type")))
        e = matching.evaluate(met.select(*PLACE, F.col("l.id").alias("anchor"), "own", _row("l", FIELDS).alias("l"), _row("r", FIELDS).alias("r"), "_kind", "brands", *more))
        rank = F.when(F.col("status") == "direct", 0).when(F.col("status") == "close", 1).otherwise(2)
        e = e.where(F.col("status").isin(*STATUSES)).select(*PLACE, "anchor", "own", rank.alias("rank"), *[F.col("risk")[i].alias(r) for i, r in enumerate(RISK)], F.col("missing_mandatory").alias("missing"), "reserves", "r", "_kind", *more, F.explode("brands").alias("b"))
        return e.where("own <> b.brand").select(*POINT[:5], F.col("b.brand").alias("brand"), *POINT[6:], "missing", "reserves", "r", "_kind", "b.near", "b.lost", *more)

    def holding(self, near: DataFrame, points: DataFrame) -> DataFrame:
        """anchor, brand, rank, missing, layer, the kind and x, one of its near lengths, for every kind and length that makes one of
        the points(anchor, brand, rank, RISK, reserves, gap, layer; missing, if it counts). Points are found by a 64-bit hash and
        compared."""
        named = [c for c in ("brand", "rank", *RISK, "missing", "reserves", "gap") if c in points.columns]
        wanted = F.collect_list(F.struct(F.xxhash64(*named).alias("code"), *named, "layer"))
        asked = points.groupBy("anchor").agg(wanted.alias("wanted")).withColumn("codes", F.col("wanted.code"))
        e = self.evaluated(near, asked).select("*", F.explode("near").alias("x")).withColumn("gap", F.col("x.gap"))
        e = e.withColumn("w", F.array_position("codes", F.xxhash64(*named)).cast("int")).where("w > 0").withColumn("w", F.get("wanted", F.col("w") - 1))
        return e.where(reduce(lambda x, y: x & y, [F.col(f"w.{c}") == F.col(c) for c in named])).select("anchor", "brand", "rank", "missing", "w.layer", "_known", "_kind", "r", "x")


def wi7_first_layer(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that no other of their anchor, brand and status beats: no risk larger and one smaller, or equal risks
    and a smaller length gap, or then fewer reserves."""
    c = _Candidates(spark, d, 0)
    near = c.near(1)
    nearest = c.evaluated(near).withColumn("gap", F.col("near")[0]["gap"]).groupBy(*POINT, "reserves").agg(F.min("gap").alias("gap"))
    front = matching.layered(nearest, POINT[:7], RISK, ["gap", "reserves"], front=True)
    of = c.holding(near, written(front, "front"))
    same = reduce(lambda x, y: x & y, [F.col(f"p.{k}") == F.col(f"e.{k}") for k in ("_kind", "_known", "brand")] + [F.col("p.length").eqNullSafe(F.col("e.x.length"))] + [F.col(f"p.{k}").eqNullSafe(F.col(f"e.r.{k}")) for k in FIELDS])
    return of.alias("e").join(c.seen.alias("p"), same).select("anchor", F.col("id").alias("candidate"), F.element_at(F.array(*map(F.lit, STATUSES)), F.col("rank") + 1).alias("status"))


def _first(spark: SparkSession, d: str, top: int) -> DataFrame:
    """The first candidates of each anchor and brand by status, missing mandatory fields, layer and id: anchor, brand, rank, layer,
    candidate, place.

    The first ``top`` layers of a group are those of the nearest lengths in each kind, so only these are laid. Where they do
    not settle the order (candidates that miss less lie in later layers) all lengths are.
    """
    c = _Candidates(spark, d, top)
    near = c.near(top)
    laid = written(_laid(c.evaluated(near), top), "laid")
    known = F.col("layer") <= top
    place, block = Window.partitionBy("anchor", "brand"), ["rank", "missing"]
    left = laid.groupBy("anchor", "brand", *block).agg(F.sum("lost").alias("lost"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"), F.count_if(~known).alias("later"))
    left = left.withColumn("before", F.sum("n").over(place.orderBy(*block))).where(((F.col("lost") > 0) | (F.col("later") > 0)) & (F.col("before") < top))
    unsettled = written(left.groupBy("anchor").agg(F.collect_set("brand").alias("brands_asked")), "unsettled")
    chosen, whole = [(near, laid.where(known))], unsettled.isEmpty()
    if not whole:
        every, pairs = c.near(None), unsettled.select("anchor", F.explode("brands_asked").alias("brand"))
        again = _laid(c.evaluated(every, unsettled).where(F.array_contains("brands_asked", F.col("brand"))), None)
        chosen = [(near, chosen[0][1].join(pairs, ["anchor", "brand"], "left_anti")), (every, written(again, "laid_whole"))]
    order = [*block, "layer"]
    first = place.orderBy(*order, "candidate")
    if top > 1:
        until = F.sum("n").over(place.orderBy(*order)) - F.sum("n").over(Window.partitionBy("anchor", "brand", *order))
        chosen = [(kinds, c.holding(kinds, written(x.withColumn("until", until).where(F.col("until") < top), "chosen")).withColumn("candidate", F.explode("x.ids"))) for kinds, x in chosen]
    out = reduce(DataFrame.unionAll, [x.select("anchor", "brand", *order, "candidate") for _, x in chosen])
    return out.withColumn("place", F.row_number().over(first).cast("long")).where(F.col("place") <= top)


def _laid(e: DataFrame, top: int | None) -> DataFrame:
    """POINT, missing, gap, reserves with the layer, candidate (the least), n (candidates, as far as ids are held) and lost (those of
    lengths that are not near). Points whose status cannot count are left out."""
    e = e.select(*POINT, "missing", "reserves", "lost", F.posexplode("near").alias("at", "x"))
    lost = F.sum(F.when(F.col("at") == 0, F.col("lost")).otherwise(0))
    points = e.withColumn("gap", F.col("x.gap")).groupBy(*POINT, "missing", "gap", "reserves").agg(F.sum(F.size("x.ids")).alias("n"), lost.alias("lost"), F.min(F.get("x.ids", F.lit(0))).alias("candidate"))
    if top:
        w = Window.partitionBy(*POINT[:6])
        better = [F.sum(F.when(F.col("rank") < r, F.col("n")).otherwise(0)).over(w) for r in (1, 2)]
        points = points.withColumns({"_0": better[0], "_1": better[1]}).where(F.when(F.col("rank") == 0, 0).when(F.col("rank") == 1, F.col("_0")).otherwise(F.col("_1")) < top).drop("_0", "_1")
    return matching.layered(points, POINT[:7], RISK, ["gap", "reserves"])


def co2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each brand: status, missing mandatory fields, layer, then id."""
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("rank") + 1)
    return _first(spark, d, 1).select("anchor", "brand", "candidate", status.alias("status"), F.col("layer").cast("long").alias("layer"))


def wi8_brand_order(spark: SparkSession, d: str) -> DataFrame:
    """The first three candidates of each brand in that order."""
    return _first(spark, d, 3).select("anchor", "brand", "candidate", "place")


def ag6_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Attribute values that all sources agree on, and conflicts."""
    return checks.consensus(attr(spark, d), ["rule_id", "name"], "value")


def ag8_completeness(spark: SparkSession, d: str) -> DataFrame:
    """By brand: products, agreed values, conflicts and the share agreed."""
    c = checks.consensus(attr(spark, d), ["rule_id", "name"], "value")
    out = rule(spark, d).select("rule_id", "manufacturer").join(c, "rule_id").groupBy("manufacturer").agg(F.count_distinct("rule_id").alias("products"), F.count("value").alias("agreed"), F.count_if("conflict").alias("conflicts"), F.count("*").alias("fields"))
    return out.withColumn("share", F.round(F.try_divide("agreed", "fields") * 100, 4))


def ag9_coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Brand by field: products and those with a known, agreed value."""
    c = checks.consensus(attr(spark, d), ["rule_id", "name"], "value")
    grid = rule(spark, d).select("rule_id", "manufacturer", F.explode(F.array(*[F.lit(x) for x in ("Size, mm", "Type", "Color", "VAT")])).alias("name"))
    out = grid.join(c, ["rule_id", "name"], "left").groupBy("manufacturer", "name")
    return out.agg(F.count("*").alias("total"), F.count("sightings").alias("raw"), F.count("value").alias("known"), F.count_if(F.coalesce("conflict", F.lit(False))).alias("conflicts"))


def ag10_attribute_frequency(spark: SparkSession, d: str) -> DataFrame:
    return attr(spark, d).join(rule(spark, d).select("rule_id", "manufacturer"), "rule_id").groupBy("manufacturer", "name").agg(F.count("*").alias("n"))


def li6_samples(spark: SparkSession, d: str) -> DataFrame:
    """At most three example values of each attribute name, the least first."""
    v = attr(spark, d).select("name", "value").distinct()
    return v.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("value")).cast("long")).where("k <= 3")


def sk2_wide_export(spark: SparkSession, d: str) -> DataFrame:
    """One row for each product, a column for each attribute, distinct values joined."""
    a = attr(spark, d).distinct().groupBy("rule_id").pivot("name", ["Size, mm", "Type", "Color", "VAT"]).agg(F.array_join(F.array_sort(F.collect_list("value")), "; "))
    return a.select("rule_id", F.col("`Size, mm`").alias("size"), F.col("Type").alias("type"), F.col("Color").alias("color"), F.col("VAT").alias("vat"))


def sk2_long_export(spark: SparkSession, d: str) -> DataFrame:
    """The long table beside it: every different property of a product, numbered."""
    w = Window.partitionBy("rule_id").orderBy("name", "value")
    return attr(spark, d).distinct().select("rule_id", F.row_number().over(w).cast("long").alias("line"), "name", "value")


def fn25_price_views(spark: SparkSession, d: str) -> DataFrame:
    q = quote(spark, d).where("status = 'priced'")
    p, b, r = F.col("price"), F.col("basis"), F.col("rate")
    return q.select("rule_id", "run_id", "line_no", p.cast("double").alias("internet"), prices.gross_price(p, b, r).alias("gross"), prices.net_price(p, b, r).alias("net"))


def _quotes(spark: SparkSession, d: str, basis: str) -> DataFrame:
    q = history.latest(quote(spark, d).where((F.col("status") == "priced") & (F.col("basis") == basis)), ["rule_id"], QUOTE_ORDER, ["price", "rate"])
    return q.select("rule_id", F.struct("price", F.when(F.col("rule_id") % 9 == 0, "USD").otherwise("RUB").alias("currency"), F.when(F.col("rule_id") % 4 != 0, "piece").alias("unit"), F.lit(basis).alias("basis"), "rate").alias(basis))


def fn27_delta(spark: SparkSession, d: str) -> DataFrame:
    """The last net quote of a product as the own price against its last gross one."""
    both = _quotes(spark, d, "net").join(_quotes(spark, d, "gross"), "rule_id", "full")
    return both.select("rule_id", prices.delta("net", "gross").alias("x")).select("rule_id", "x.delta", "x.gap", "x.note")


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    q = quote(spark, d).where("status = 'priced'")
    stats = history.first_last(q, ["rule_id", "basis"], QUOTE_ORDER, "price", F.lit(True))
    return stats.join(rule(spark, d).select("rule_id", "manufacturer", "category"), "rule_id")


def _models(spark: SparkSession, d: str) -> DataFrame:
    """For each product its last price of other sources with currency, unit, basis and rate, the change since the first
    one where these four agree, and delta and gap to the own price where the analogue is direct, the price current and
    the terms comparable.

    Here own quotes are those of sources divisible by 10; source and size stand for currency, unit and directness.
    """
    priced, row, own = F.col("status") == "priced", F.struct(*QUOTE_ORDER), F.col("source_id") % 10 == 0
    q = quote(spark, d).groupBy("rule_id").agg(F.min(F.when(priced & ~own, row)).alias("a"), F.max(F.when(priced & ~own, row)).alias("b"), F.max(F.when(~own, row)).alias("seen"), F.max(F.when(priced & own, row)).alias("o"), F.count_if(priced & ~own).alias("points"))

    def terms(x: str) -> F.Column:
        s = F.col(f"{x}.source_id")
        return F.struct(F.col(f"{x}.price").cast("double").alias("price"), F.when(s.isNotNull(), F.when(s % 9 == 0, "USD").otherwise("RUB")).alias("currency"), F.when(s % 4 != 0, "piece").alias("unit"), F.coalesce(f"{x}.basis", F.lit("unknown")).alias("basis"), F.col(f"{x}.rate").alias("rate")).alias(x)

    m = rule(spark, d).join(q, "rule_id", "left").withColumn("current", F.col("b").eqNullSafe(F.col("seen"))).select("rule_id", "manufacturer", "category", "size", "current", "points", terms("a"), terms("b"), terms("o"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("currency", "unit", "basis", "rate")])
    change = F.when(same & (F.col("a.price") != 0) & (F.col("b.price") != 0) & (F.col("points") > 1), (F.col("b.price") / F.col("a.price") - 1) * 100)
    ok = (F.col("size") % 2 == 0) & F.col("current") & (F.col("o.price") != 0) & (F.col("o.currency") == F.col("b.currency")) & prices.comparable("b", "o")
    m = m.withColumn("change", change).withColumn("delta", F.when(ok, F.col("b.price") - F.col("o.price"))).withColumn("gap", F.col("delta") / F.col("o.price") * 100)
    return m.select("rule_id", "manufacturer", "category", F.when(F.col("size") < 25, "small").otherwise("large").alias("execution"), "b.currency", "b.unit", "b.basis", "b.rate", "b.price", "change", "delta", "gap")


def co4_model_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    return m.select("rule_id", "currency", "unit", "basis", "rate", "price", *[F.round(c, 4).alias(c) for c in ("change", "delta", "gap")])


def ag5_price_analytics(spark: SparkSession, d: str) -> DataFrame:
    """By brand, currency, unit, basis and rate, and below that by category and execution: models, those with a price, a
    change or a gap; the mean price only where unit and basis are known."""
    keys, finer = ["manufacturer", "currency", "unit", "basis", "rate"], ["category", "execution"]
    known = F.col("unit").isNotNull() & (F.col("basis") != "unknown")
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    g = _models(spark, d).groupingSets([keys, keys + finer], *keys, *finer)
    return g.agg(F.count("*").alias("models"), F.count("price").alias("priced"), F.count("change").alias("with_dynamics"), mean(F.when(known, F.col("price")), "mean_price"), mean("change", "mean_change"), F.round(F.min("change"), 4).alias("least_change"), F.round(F.max("change"), 4).alias("most_change"), F.count("gap").alias("pairs"), mean("delta", "mean_delta"), mean("gap", "mean_gap"), F.grouping("category").cast("int").alias("whole"))


def fi3_search(spark: SparkSession, d: str) -> DataFrame:
    """Products that hold all words of a query, in any case."""
    text = F.lower(F.concat_ws(" ", "manufacturer", "title", "category"))
    return rule(spark, d).where(text.contains("brand#1") & text.contains("ring")).select("rule_id", "title")


def li3_search_order(spark: SparkSession, d: str) -> DataFrame:
    """A search page: exact brand first, then titles that begin with the word, then by title and id; ten rows."""
    r = rule(spark, d).where(F.lower(F.concat_ws(" ", "manufacturer", "title")).contains("a"))
    order = [F.when(F.col("manufacturer") == "Brand#11", 0).otherwise(1), F.when(F.col("title").startswith("a"), 0).otherwise(1), F.col("title"), F.col("rule_id")]
    return r.orderBy(*order).limit(10).select("rule_id", "title")


def li1_page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """The third page of ten products by price, with the number of all."""
    r = rule(spark, d).where("size between 10 and 20")
    total = r.agg(F.count("*").alias("total")).withColumn("k", F.lit(1))
    return r.orderBy(F.desc("list_price"), "rule_id").offset(20).limit(10).select("rule_id", F.lit(1).alias("k")).join(total, "k").select("rule_id", "total")


def li2_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).where("rule_id > 50").orderBy("rule_id").limit(25).select("rule_id", "title")


def jo12_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every product's title with its size, a third of them misspelt, looked up in the catalogue: missing, exact, ambiguous,
    or asked for on an earlier line."""
    r = rule(spark, d)
    name = F.concat_ws(" ", "manufacturer", "title", F.col("size").cast("string"))
    wanted = r.select(F.col("rule_id").alias("line"), F.when(F.col("rule_id") % 3 == 0, F.concat(name, F.lit(" x"))).otherwise(name).alias("name"))
    return checks.resolve(wanted, r.select(name.alias("name"), "rule_id"), "name", "rule_id", "line")


def co16_facets(spark: SparkSession, d: str) -> DataFrame:
    """Options of each facet under the criteria of the others."""
    r = rule(spark, d)
    brand, size = F.col("manufacturer") == "Brand#11", F.col("size") < 20
    a = r.where(size).groupBy(F.lit("manufacturer").alias("facet"), F.col("manufacturer").alias("option")).agg(F.count("*").alias("n"))
    return a.union(r.where(brand).groupBy(F.lit("size"), F.col("size").cast("string")).agg(F.count("*")))


def wi6_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Second and later products of a brand, category and size."""
    w = Window.partitionBy("manufacturer", "category", "size").orderBy("rule_id")
    return rule(spark, d).withColumn("k", F.row_number().over(w).cast("long")).where("k > 1").select("rule_id", "k")


def ag22_brands(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).groupBy("manufacturer").agg(F.count("*").alias("n"))


def fn24_terms(spark: SparkSession, d: str) -> DataFrame:
    """Tax terms read back from text."""
    q = quote(spark, d).select(F.concat(F.col("price").cast("string"), F.when(F.col("basis") == "net", " excl. VAT ").otherwise(" incl. VAT "), F.col("rate").cast("string"), F.when(F.col("line_no") % 2 == 0, " % per pack").otherwise(" % per piece")).alias("text"))
    return q.select(prices.parse_terms(F.col("text")).alias("t")).groupBy(F.col("t.basis").alias("basis"), F.col("t.rate").alias("rate"), F.col("t.unit").alias("unit")).agg(F.count("*").alias("n"))


def fn15_money(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written with thousands spaces and a currency, read back; pairs of numbers are refused."""
    r = rule(spark, d)
    text = F.when(F.col("rule_id") % 3 == 0, F.concat(F.col("list_price").cast("string"), F.lit(" RUB"))).when(F.col("rule_id") % 3 == 1, F.regexp_replace(F.format_number(F.col("list_price"), 2), ",", " ")).otherwise(F.concat(F.col("list_price").cast("string"), F.lit(" / 20 %")))
    return r.select("rule_id", prices.parse_money(text).cast("double").alias("amount"))


def fn19_with_tax(spark: SparkSession, d: str) -> DataFrame:
    q = quote(spark, d).where("basis = 'net'")
    return q.groupBy("rate").agg(F.sum(prices.with_tax(F.col("price"), F.col("rate"))).cast("double").alias("gross"))


_OUTCOMES = {
    "body_type": ("mandatory", "'incompatible'"), "diameter": ("mandatory", "'incompatible'"), "output": ("mandatory", "'incompatible'"),
    "sn": ("important", "'difference'"), "tmin": ("important", "case when r.tmin < l.tmin then 'reserve' else 'difference' end"), "tmax": ("important", "case when r.tmax > l.tmax then 'reserve' else 'difference' end"),
    "material": ("important", "'difference'"), "load": ("important", "case when r.load > l.load then 'reserve' else 'difference' end"), "length": ("secondary", "'secondary'"), "wire_count": ("secondary", "'secondary'"),
}


def _sql_status() -> str:
    """Evaluation of all pairs as SQL."""
    outcomes = ", ".join(f"case when l.{n} is null or r.{n} is null then 'missing' when l.{n} = r.{n} then 'exact' else {x} end o_{n}, l.{n}::varchar l_{n}, r.{n}::varchar r_{n}" for n, (_, x) in _OUTCOMES.items())

    def total(value: str, *groups: str) -> str:
        return " + ".join(f"(o_{n} = '{value}')::bigint" for n, (g, _) in _OUTCOMES.items() if g in groups)

    inf = "'infinity'::double"
    return f"""with recursive {SENSORS_SQL}, p as (select l.id a, r.id c, r.brand brand, l.body_type body, l.diameter ld, r.diameter rd, {outcomes},
  greatest(0, r.tmin - l.tmin)::double r0, greatest(0, l.tmax - r.tmax)::double r1, coalesce(abs(l.sn - r.sn)::double, {inf}) r2, case when l.material is null or r.material is null then {inf} else (l.material <> r.material)::int::double end r3, greatest(0, l.load - r.load)::double r4, abs(l.length - r.length)::double length_gap
  from s l join s r on l.id % 100 = 0 and l.brand <> r.brand and (l.body_type = r.body_type or l.body_type is null or r.body_type is null) and (l.diameter = r.diameter or l.diameter is null or r.diameter is null)),
 e as (select *, {total("difference", "important")} differences, {total("reserve", "important")} reserves, {total("missing", "mandatory")} missing_mandatory,
  case when o_output = 'incompatible' then 'incompatible' when coalesce(body, 'smooth') = 'rect' or o_wire_count = 'secondary' or {total("missing", "mandatory", "important")} > 0 then 'review' when {total("difference", "important")} > 0 then 'close' else 'direct' end status from p),
 k as (select * from e where status in ('direct', 'close', 'review') and (ld is null or rd is not null))"""


_BEATS = "(y.r0 <= x.r0 and y.r1 <= x.r1 and y.r2 <= x.r2 and y.r3 <= x.r3 and y.r4 <= x.r4 and (y.r0 < x.r0 or y.r1 < x.r1 or y.r2 < x.r2 or y.r3 < x.r3 or y.r4 < x.r4 or y.length_gap < x.length_gap or (y.length_gap = x.length_gap and y.reserves < x.reserves)) and ((y.r0, y.r1, y.r2, y.r3, y.r4) <> (x.r0, x.r1, x.r2, x.r3, x.r4) or y.length_gap < x.length_gap or (y.length_gap = x.length_gap and y.reserves < x.reserves)))"
#: Longest chain of points that beat a point, and itself: its layer.
_LAYERS = f""", q as (select distinct a, brand, status, r0, r1, r2, r3, r4, length_gap, reserves from k), lay as (select q.*, 1 as layer from q union select x.*, y.layer + 1 from lay y join q x on y.a = x.a and y.brand = x.brand and y.status = x.status and {_BEATS}),
 deep as (select a, brand, status, r0, r1, r2, r3, r4, length_gap, reserves, max(layer) as layer from lay group by all),
 z as (select k.*, layer, case status when 'direct' then 0 when 'close' then 1 else 2 end rank from k join deep using (a, brand, status, r0, r1, r2, r3, r4, length_gap, reserves))"""


def _last(basis: str) -> str:
    return f"(select rule_id, max((checked_at, run_id, line_no, source_id, price, basis, rate)) m from quote where status = 'priced' and basis = '{basis}' group by 1)"


QUERIES = {f.__name__: f for f in (jo11_wildcard_blocks, co1_analogues, co18_match_evidence, wi7_first_layer, co2_ranking, wi8_brand_order, ag6_consensus, ag8_completeness, ag9_coverage_matrix, ag10_attribute_frequency, li6_samples, sk2_wide_export, sk2_long_export, fn25_price_views, fn27_delta, co4_model_statistics, ag5_price_analytics, fi3_search, li3_search_order, li1_page_with_total, li2_keyset_page, jo12_resolve, co16_facets, wi6_duplicates, ag22_brands, fn24_terms, fn15_money, fn19_with_tax)}
STATS = "select rule_id, basis, count(*) points, arg_min(price, (checked_at, run_id, line_no, source_id, price, rate))::double a, arg_max(price, (checked_at, run_id, line_no, source_id, price, rate))::double b from quote where status = 'priced' group by 1, 2"
_ROW = "(checked_at, run_id, line_no, source_id, price, basis, rate)"
MODELS = f"""e as (select rule_id, min({_ROW}) filter (status = 'priced') a, max({_ROW}) filter (status = 'priced') b, max({_ROW}) seen, count_if(status = 'priced') points from quote where source_id % 10 <> 0 group by 1),
  w as (select rule_id, max({_ROW}) o from quote where status = 'priced' and source_id % 10 = 0 group by 1),
  t as (select rule_id, manufacturer, category, size, points, b is not distinct from seen is_current, case when b is not null then case when b[4] % 9 = 0 then 'USD' else 'RUB' end end currency, case when b[4] % 4 <> 0 then 'piece' end unit, coalesce(b[6], 'unknown') basis, b[7] rate, b[5]::double price,
    a[5]::double first_price, (a[4] % 9 = 0) = (b[4] % 9 = 0) and (a[4] % 4 = 0) = (b[4] % 4 = 0) and a[6] = b[6] and a[7] = b[7] same, o[5]::double own, (o[4] % 9 = 0) = (b[4] % 9 = 0) and o[4] % 4 <> 0 and b[4] % 4 <> 0 and o[6] = b[6] and o[7] = b[7] fits from rule left join e using (rule_id) left join w using (rule_id)),
  d as (select *, case when same and points > 1 and price <> 0 and first_price <> 0 then (price / first_price - 1) * 100 end change, case when size % 2 = 0 and is_current and fits and own <> 0 then price - own end delta from t),
  m as (select *, delta / own * 100 gap, case when size < 25 then 'small' else 'large' end execution from d)"""
SQL = {
    "jo11_wildcard_blocks": f"with {SENSORS_SQL} select l.id anchor, count(*) candidates, sum(r.id)::bigint id_sum from s l join s r on l.id % 100 = 0 and l.brand <> r.brand and (l.body_type = r.body_type or l.body_type is null or r.body_type is null) and (l.diameter = r.diameter or l.diameter is null or r.diameter is null) group by 1",
    "co1_analogues": _sql_status() + " select a anchor, c candidate, status, differences, reserves, missing_mandatory from e",
    "co18_match_evidence": _sql_status() + ", m as (select * from e where status in ('direct', 'close')) " + " union all ".join(f"select a anchor, c chosen, '{n}' as field, '{g}' kind, l_{n} reference, r_{n} candidate, o_{n} outcome from m" for n, (g, _) in _OUTCOMES.items()),
    "wi7_first_layer": _sql_status() + f" select a anchor, c candidate, status from k x where not exists (select 1 from k y where y.a = x.a and y.brand = x.brand and y.status = x.status and {_BEATS})",
    "co2_ranking": _sql_status() + _LAYERS + " select a anchor, brand, arg_min(c, (rank, missing_mandatory, layer, c)) candidate, arg_min(status, (rank, missing_mandatory, layer, c)) status, arg_min(layer, (rank, missing_mandatory, layer, c))::bigint as layer from z group by 1, 2",
    "wi8_brand_order": _sql_status() + _LAYERS + ", o as (select a anchor, brand, c candidate, row_number() over (partition by a, brand order by rank, missing_mandatory, layer, c) place from z) select * from o where place <= 3",
    "ag6_consensus": "select rule_id, name, case when count(distinct value) = 1 then min(value) end as value, count(distinct value) > 1 conflict, count(value) sightings from attr group by 1, 2",
    "ag8_completeness": "with c as (select rule_id, name, count(distinct value) n from attr group by 1, 2) select manufacturer, count(distinct rule_id) products, count_if(n = 1) agreed, count_if(n > 1) conflicts, count(*) fields, round(count_if(n = 1) / count(*) * 100, 4) as share from rule join c using (rule_id) group by 1",
    "ag9_coverage_matrix": "with c as (select rule_id, name, count(distinct value) n from attr group by 1, 2), g as (select rule_id, manufacturer, f.name from rule, (values ('Size, mm'), ('Type'), ('Color'), ('VAT')) f(name)) select manufacturer, name, count(*) total, count(n) raw, count_if(coalesce(n, 0) = 1) known, count_if(coalesce(n, 0) > 1) conflicts from g left join c using (rule_id, name) group by 1, 2",
    "ag10_attribute_frequency": "select manufacturer, name, count(*) n from attr join rule using (rule_id) group by 1, 2",
    "li6_samples": "select name, value, k from (select name, value, row_number() over (partition by name order by value) k from (select distinct name, value from attr)) where k <= 3",
    "sk2_wide_export": "with v as (select distinct rule_id, name, value from attr) select rule_id, string_agg(value, '; ' order by value) filter (name = 'Size, mm') size, string_agg(value, '; ' order by value) filter (name = 'Type') as type, string_agg(value, '; ' order by value) filter (name = 'Color') color, string_agg(value, '; ' order by value) filter (name = 'VAT') vat from v group by 1",
    "sk2_long_export": "select rule_id, row_number() over (partition by rule_id order by name, value) line, name, value from (select distinct rule_id, name, value from attr)",
    "fn25_price_views": "select rule_id, run_id, line_no, price::double internet, case when basis = 'gross' then price::double else price::double * (1 + rate / 100.0) end gross, case when basis = 'net' then price::double else price::double / (1 + rate / 100.0) end net from quote where status = 'priced'",
    "fn27_delta": f"""with n as {_last("net")}, g as {_last("gross")}, j as (select rule_id, n.m[5]::double a, n.m[7] ra, g.m[5]::double b from n full join g using (rule_id)), k as (select rule_id, a * (1 + ra / 100.0) a2, b, a is null or b is null missing from j)
  select rule_id, case when not missing then round(b - a2, 2) end delta, case when not missing then round((b - a2) / a2 * 100, 4) end gap, case when missing then 'no price' when rule_id % 4 = 0 then 'unit unknown' else '' end note from k""",
    "co4_model_statistics": f"with {MODELS} select rule_id, currency, unit, basis, rate, price, round(change, 4) change, round(delta, 4) delta, round(gap, 4) gap from m",
    "ag5_price_analytics": f"with {MODELS} select manufacturer, currency, unit, basis, rate, category, execution, count(*) models, count(price) priced, count(change) with_dynamics, round(avg(case when unit is not null and basis <> 'unknown' then price end), 4) mean_price, round(avg(change), 4) mean_change, round(min(change), 4) least_change, round(max(change), 4) most_change, count(gap) pairs, round(avg(delta), 4) mean_delta, round(avg(gap), 4) mean_gap, grouping(category)::int as whole from m group by grouping sets ((manufacturer, currency, unit, basis, rate), (manufacturer, currency, unit, basis, rate, category, execution))",
    "fi3_search": "select rule_id, title from rule where lower(manufacturer || ' ' || title || ' ' || category) like '%brand#1%' and lower(manufacturer || ' ' || title || ' ' || category) like '%ring%'",
    "li3_search_order": "select rule_id, title from rule where lower(manufacturer || ' ' || title) like '%a%' order by manufacturer <> 'Brand#11', not starts_with(title, 'a'), title, rule_id limit 10",
    "li1_page_with_total": "select rule_id, (select count(*) from rule where size between 10 and 20) total from rule where size between 10 and 20 order by list_price desc, rule_id limit 10 offset 20",
    "li2_keyset_page": "select rule_id, title from rule where rule_id > 50 order by rule_id limit 25",
    "jo12_resolve": "with c as (select rule_id, manufacturer || ' ' || title || ' ' || size n from rule), w as (select rule_id line, case when rule_id % 3 = 0 then n || ' x' else n end as name from c), k as (select n as name, count(distinct rule_id) c, min(rule_id) t from c group by 1), f as (select name, min(line) first from w group by 1) select line, name, case when line > first then 'duplicate' when c is null then 'missing' when c = 1 then 'exact' else 'ambiguous' end state, case when c = 1 and line = first then t end rule_id from w join f using (name) left join k using (name)",
    "co16_facets": "select 'manufacturer' facet, manufacturer as option, count(*) n from rule where size < 20 group by 2 union all select 'size', size::varchar, count(*) from rule where manufacturer = 'Brand#11' group by 2",
    "wi6_duplicates": "select rule_id, k from (select rule_id, row_number() over (partition by manufacturer, category, size order by rule_id) k from rule) where k > 1",
    "ag22_brands": "select manufacturer, count(*) n from rule group by 1",
    "fn24_terms": "select basis, rate, case when line_no % 2 = 0 then 'pack' else 'piece' end unit, count(*) n from quote group by all",
    "fn15_money": "select rule_id, case when rule_id % 3 <> 2 then list_price::double end amount from rule",
    "fn19_with_tax": "select rate, sum(round(price * (100 + rate) / 100, 2)::decimal(18,2))::double gross from quote where basis = 'net' group by 1",
}
