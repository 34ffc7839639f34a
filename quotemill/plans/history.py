"""Queries over the price history: latest and as-of rows, segments, keyed writes, carried state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.operators import history as h
from quotemill.session import table
from quotemill.sources.views import attr, obs, quote, rule

QUOTE_ORDER = ["checked_at", "run_id", "line_no", "source_id", "price", "basis", "rate"]
def success():
    return F.col("status").isin("priced", "on_request", "no_price")



def sc1_history_scan(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the small products in a half-open range of days."""
    ids = rule(spark, d).where("size < 10").select("rule_id")
    return obs(spark, d).where((F.col("checked_at") >= "2024-01-02") & (F.col("checked_at") < "2024-01-20")).join(ids, "rule_id", "left_semi")


def jo2_latest_check(spark: SparkSession, d: str) -> DataFrame:
    """For each product its last check and its last priced check, in one aggregate."""
    o = obs(spark, d)
    row, place, priced = F.struct("obs_id", "status", "price"), F.struct("checked_at", "obs_id"), F.col("status") == "priced"
    out = o.groupBy("rule_id").agg(F.max_by(row, place).alias("a"), F.max_by(F.when(priced, row), F.when(priced, place)).alias("p"))
    return out.select("rule_id", F.col("a.obs_id").alias("latest_id"), F.col("a.status").alias("latest_status"), F.col("p.obs_id").alias("priced_id"), F.col("p.price").cast("double").alias("priced_price"))


def jo1_product_card(spark: SparkSession, d: str) -> DataFrame:
    """Product with its number of attributes, last check, last price, own price (here: the last priced quote) and lifecycle
    state (review after a last check that found nothing), each with its default."""
    place, priced, counted = F.struct("checked_at", "obs_id"), F.col("status") == "priced", success() | (F.col("status") == "not_found")
    row = F.struct("obs_id", "status", "price")
    last = obs(spark, d).groupBy("rule_id").agg(F.max_by(row, place).alias("a"), F.max_by(F.when(priced, row), F.when(priced, place)).alias("p"), F.max_by(F.when(counted, F.col("status")), F.when(counted, place)).alias("life"))
    index = attr(spark, d).groupBy("rule_id").agg(F.count_distinct("name").alias("attributes"))
    own = quote(spark, d).where("status = 'priced'").groupBy("rule_id").agg(F.max_by("price", F.struct(*QUOTE_ORDER)).alias("own_price"))
    j = rule(spark, d).join(index, "rule_id", "left").join(last, "rule_id", "left").join(own, "rule_id", "left")
    state = F.when(F.col("life") == "not_found", "review").otherwise("active")
    return j.select("rule_id", "manufacturer", "title", F.coalesce("attributes", F.lit(0)).alias("attributes"), F.coalesce("a.status", F.lit("pending")).alias("status"), F.col("a.obs_id").alias("latest_id"), F.col("p.obs_id").alias("priced_id"), F.col("p.price").cast("double").alias("last_price"), F.col("own_price").cast("double").alias("own_price"), F.col("own_price").isNotNull().alias("selected"), state.alias("state"))


def wi1_dual_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every check's place from the last, and from the last with priced checks first."""
    o = obs(spark, d)
    w = Window.partitionBy("rule_id")
    return o.select("obs_id", "rule_id", F.row_number().over(w.orderBy(F.desc("checked_at"), F.desc("obs_id"))).cast("long").alias("place"), F.row_number().over(w.orderBy(F.when(F.col("status") == "priced", 0).otherwise(1), F.desc("checked_at"), F.desc("obs_id"))).cast("long").alias("priced_place"))


def wi2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Price lines: a failed check or another currency breaks them."""
    out = h.segments(obs(spark, d), ["rule_id"], ["checked_at", "obs_id"], (F.col("status") != "priced") | (F.col("currency") != "RUB"))
    return out.select("rule_id", "obs_id", F.col("price").cast("double").alias("price"), "segment")


def wi3_first_last(spark: SparkSession, d: str) -> DataFrame:
    out = h.first_last(obs(spark, d), ["rule_id"], ["checked_at", "obs_id"], "price", (F.col("status") == "priced") & (F.col("currency") == "RUB"))
    return out.select("rule_id", F.col("first_value").cast("double").alias("first_value"), F.col("last_value").cast("double").alias("last_value"), "points", F.round("change", 4).alias("change"))


def jo4_as_of_price(spark: SparkSession, d: str) -> DataFrame:
    """The last quote of the product on or before the day of each order line."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("rule_id"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line"), F.col("o_orderdate").alias("day"))
    out = h.as_of(lines, quote(spark, d), ["rule_id"], "day", "checked_at", QUOTE_ORDER, ["checked_at", "run_id", "line_no"], once=True)
    return out.select("rule_id", "run", "line", F.col("run_id").alias("quote_run"), F.col("line_no").alias("quote_line"))


def jo5_as_of_month(spark: SparkSession, d: str) -> DataFrame:
    """For each quote's product and month: the last valid check of that month, if any."""
    valid = obs(spark, d).where(success()).withColumn("month", F.date_trunc("month", "checked_at"))
    last = h.latest(valid, ["rule_id", "month"], ["checked_at", "obs_id"], ["obs_id"])
    want = obs(spark, d).where(~success()).select("rule_id", F.date_trunc("month", "checked_at").alias("month")).distinct()
    return want.join(last, ["rule_id", "month"], "left").select("rule_id", F.date_format("month", "yyyy-MM").alias("month"), "obs_id")


def jo6_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Products with a valid check, with the day of the last, among those that have a quote."""
    valid = obs(spark, d).where(success()).groupBy("rule_id").agg(F.max("checked_at").alias("t"))
    return valid.join(quote(spark, d).select("rule_id"), "rule_id", "left_semi").select("rule_id", F.date_format("t", "yyyy-MM-dd").alias("day"))


def jo7_recent_rules(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).join(obs(spark, d).where(F.col("checked_at") >= "2024-01-15").select("rule_id"), "rule_id", "left_semi").select("rule_id", "manufacturer")


def jo8_never_checked(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).join(obs(spark, d).where(success()).select("rule_id"), "rule_id", "left_anti").select("rule_id", "manufacturer")


def jo3_actual_or_reused(spark: SparkSession, d: str) -> DataFrame:
    """Job results: the job's own quote, else the last other quote of the product in its run's month."""
    q = quote(spark, d)
    jobs = q.where("status <> 'priced'").select("run_id", "line_no", "rule_id", F.date_trunc("month", F.col("checked_at").cast("timestamp_ntz")).alias("month"), "status")
    last = h.latest(q.where("status = 'priced'").withColumn("month", F.date_trunc("month", F.col("checked_at").cast("timestamp_ntz"))), ["rule_id", "month"], QUOTE_ORDER, ["run_id", "line_no"], prefix="reused_")
    out = jobs.join(last, ["rule_id", "month"], "left")
    return out.select("run_id", "line_no", F.when(F.col("reused_run_id").isNotNull(), "already_collected").otherwise(F.col("status")).alias("status"), "reused_run_id")


def sk4_last_write(spark: SparkSession, d: str) -> DataFrame:
    """The current projection by product and currency: the last write wins."""
    o = obs(spark, d)
    old, new = o.where("checked_at < '2024-01-15'"), o.where("checked_at >= '2024-01-15'")
    return h.upsert_latest(old, new, ["rule_id", "currency"], ["checked_at", "obs_id"]).select("rule_id", "currency", "obs_id", "status")


def sk5_guarded(spark: SparkSession, d: str) -> DataFrame:
    """A result of a product and day is replaced only while it isn't a success."""
    rows = obs(spark, d).withColumn("day", F.date_format("checked_at", "yyyy-MM-dd")).select("rule_id", "day", "checked_at", "obs_id", "status")
    return h.upsert_guarded(rows, ["rule_id", "day"], ["checked_at", "obs_id"], success()).select("rule_id", "day", "obs_id", "status")


def sk6_monotonic(spark: SparkSession, d: str) -> DataFrame:
    """Verified rows (priced) are never replaced by candidates; of a kind the newer one stays."""
    rank = F.when(F.col("status") == "priced", 2).when(success(), 1).otherwise(0)
    rows = obs(spark, d).select("rule_id", "checked_at", "obs_id", "status")
    return h.upsert_monotonic(rows, ["rule_id"], rank, ["checked_at", "obs_id"]).select("rule_id", "obs_id", "status")


def sk9_version_log(spark: SparkSession, d: str) -> DataFrame:
    """First sight of each distinct content of a product: appended once."""
    rows = obs(spark, d).select("rule_id", F.sha2(F.concat_ws("|", "status", "currency"), 256).alias("version"), "checked_at", "obs_id")
    return rows.groupBy("rule_id", "version").agg(F.min_by("obs_id", F.struct("checked_at", "obs_id")).alias("obs_id"), F.count("*").alias("sightings"))


def sk10_supersede(spark: SparkSession, d: str) -> DataFrame:
    """Of the kinds under a product, the last confirmed one stands and the others are superseded."""
    o = obs(spark, d).where(success())
    kinds = o.groupBy("rule_id", "status").agg(F.max(F.struct("checked_at", "obs_id")).alias("t"))
    top = F.max("t").over(Window.partitionBy("rule_id"))
    return kinds.select("rule_id", "status", F.when(F.col("t") == top, "confirmed").otherwise("superseded").alias("state"), F.col("t.obs_id").alias("obs_id"))


def sk12_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of a product's state: numbered in order; two proposals of one second conflict, the lower id wins."""
    o = obs(spark, d).select("rule_id", "obs_id", F.date_trunc("hour", "checked_at").alias("base"))
    w = Window.partitionBy("rule_id", "base")
    o = o.withColumn("proposals", F.count("*").over(w)).withColumn("winner", F.min("obs_id").over(w))
    kept = o.where("obs_id = winner").withColumn("revision", F.row_number().over(Window.partitionBy("rule_id").orderBy("base")).cast("long"))
    return kept.select("rule_id", "obs_id", "revision", (F.col("proposals") > 1).alias("conflict"))


def st1_monthly_memory(spark: SparkSession, d: str) -> DataFrame:
    """One success for each product and month; later ones of the month are counted as reuse."""
    m = obs(spark, d).where(success()).withColumn("month", F.date_format("checked_at", "yyyy-MM"))
    return m.groupBy("rule_id", "month").agg(F.min_by("obs_id", F.struct("checked_at", "obs_id")).alias("obs_id"), (F.count("*") - 1).alias("reused"))


def st3_stalls(spark: SparkSession, d: str, silent: int = 86400, inactive: int = 2 * 86400, same: int = 3 * 86400) -> DataFrame:
    """Checks of a product at which its collection stalls, with the first reason of three, each with a limit in seconds:
    no signal after it, no success for so long (from the first check where there was none), or one status for so long."""
    w = Window.partitionBy("rule_id").orderBy("checked_at", "obs_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = obs(spark, d).withColumn("next", F.lead("checked_at").over(w)).withColumn("changed", F.when(~F.col("status").eqNullSafe(F.lag("status").over(w)), F.col("checked_at")))
    o = o.withColumn("ok", F.coalesce(F.last(F.when(success(), F.col("checked_at")), ignorenulls=True).over(upto), F.first("checked_at").over(upto))).withColumn("since", F.last("changed", ignorenulls=True).over(upto))
    seconds = lambda a, b: F.timestamp_diff("SECOND", F.col(a), F.col(b))
    reason = F.when(seconds("checked_at", "next") >= silent, "silent").when(seconds("ok", "checked_at") >= inactive, "inactive").when(seconds("since", "checked_at") >= same, "same_status")
    return o.select("rule_id", "obs_id", reason.alias("reason")).where("reason is not null")


def st8_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """At each check, the last success up to it."""
    w = Window.partitionBy("rule_id").orderBy("checked_at", "obs_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return obs(spark, d).select("rule_id", "obs_id", F.last(F.when(success(), F.col("obs_id")), ignorenulls=True).over(w).alias("last_success"))


def st9_circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    out = h.failure_runs(obs(spark, d), ["rule_id"], ["checked_at", "obs_id"], F.col("status").isin("not_found", "network_error"), 3)
    return out.select("rule_id", "obs_id")


def ag16_lifecycle_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).where(success())
    return o.groupBy("rule_id").agg(F.date_format(F.min("checked_at"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format(F.max("checked_at"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.count("*").alias("checks"))


def fi6_period(spark: SparkSession, d: str) -> DataFrame:
    """Checks whose local day (UTC + 5 h) lies in a period, and which of them a month-precise reader would take."""
    local = F.col("checked_at") + F.expr("interval 5 hours")
    return obs(spark, d).where(F.to_date(local).between("2024-01-05", "2024-01-25")).select("obs_id", F.date_format(local, "yyyy-MM-dd").alias("day"), (F.last_day(local) <= F.to_date(F.lit("2024-01-25"))).alias("whole_month"))


def fi8_month_window(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_trunc("month", F.lit("2024-01-17").cast("timestamp_ntz"))
    return obs(spark, d).where(success() & (F.col("checked_at") >= start) & (F.col("checked_at") < start + F.expr("interval 1 month"))).groupBy("status").agg(F.count("*").alias("n"))


def se2_periods(spark: SparkSession, d: str) -> DataFrame:
    months = obs(spark, d).select(F.date_format("checked_at", "yyyy-MM").alias("period")).union(quote(spark, d).select(F.date_format("checked_at", "yyyy-MM").alias("period")))
    return months.union(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM"))).distinct()


def jo30_reverify(spark: SparkSession, d: str) -> DataFrame:
    """The last check of a product against the price stored before it: without a price unavailable, with another price or
    currency changed, else confirmed where it states its tax terms (here: four products in five) and not_found where not."""
    o, place = obs(spark, d), F.struct("checked_at", "obs_id")
    last = o.groupBy("rule_id").agg(F.max(F.struct("checked_at", "obs_id", "status", "price", "currency")).alias("l"))
    stored = o.where("status = 'priced'").join(last, "rule_id").where(place < F.struct("l.checked_at", "l.obs_id")).groupBy("rule_id").agg(F.max_by(F.struct("price", "currency"), place).alias("s"))
    same = (F.col("l.price") == F.col("s.price")) & (F.col("l.currency") == F.col("s.currency"))
    state = F.when(F.col("l.status") != "priced", "unavailable").when(~same, "price_changed").when(F.col("rule_id") % 5 == 0, "not_found").otherwise("confirmed")
    return stored.join(last, "rule_id").select("rule_id", state.alias("state"))


def fi19_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Products whose last priced quote has an unknown tax rate (here: a rate of 0) and whose last attempt, if there was
    one, is at least a day before the end of the history."""
    o = obs(spark, d)
    last = o.groupBy("rule_id").agg(F.max("checked_at").alias("t"))
    end = o.agg((F.max("checked_at") - F.expr("interval 1 day")).alias("limit")).withColumn("k", F.lit(1))
    open_terms = quote(spark, d).where("status = 'priced'").groupBy("rule_id").agg(F.max_by("rate", F.struct(*QUOTE_ORDER)).alias("rate")).where("rate = 0")
    out = open_terms.join(last, "rule_id", "left").withColumn("k", F.lit(1)).join(F.broadcast(end), "k").where(F.coalesce(F.col("t") <= F.col("limit"), F.lit(True)))
    return out.select("rule_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("last_attempt"))


S = "('priced', 'on_request', 'no_price')"
QUERIES = {f.__name__: f for f in (sc1_history_scan, jo2_latest_check, jo1_product_card, wi1_dual_rank, wi2_segments, wi3_first_last, jo4_as_of_price, jo5_as_of_month, jo6_confirmed, jo7_recent_rules, jo8_never_checked, jo3_actual_or_reused, sk4_last_write, sk5_guarded, sk6_monotonic, sk9_version_log, sk10_supersede, sk12_revisions, st1_monthly_memory, st3_stalls, st8_carry_forward, st9_circuit_breaker, ag16_lifecycle_bootstrap, fi6_period, fi8_month_window, se2_periods, jo30_reverify, fi19_recheck)}
LATEST = "select rule_id, arg_max(obs_id, (checked_at, obs_id)) latest_id, arg_max(status, (checked_at, obs_id)) latest_status, arg_max(obs_id, (checked_at, obs_id)) filter (status = 'priced') priced_id, arg_max(price, (checked_at, obs_id)) filter (status = 'priced') pp from obs group by rule_id"
SQL = {
    "sc1_history_scan": "select * from obs where checked_at >= '2024-01-02' and checked_at < '2024-01-20' and rule_id in (select rule_id from rule where size < 10)",
    "jo2_latest_check": f"select rule_id, latest_id, latest_status, priced_id, pp::double priced_price from ({LATEST})",
    "jo1_product_card": f"with l as ({LATEST}), i as (select rule_id, count(distinct name) n from attr group by 1), w as (select rule_id, arg_max(price, (checked_at, run_id, line_no, source_id, price, basis, rate)) own from quote where status = 'priced' group by 1), f as (select rule_id, arg_max(status, (checked_at, obs_id)) life from obs where status in {S} or status = 'not_found' group by 1) select rule_id, manufacturer, title, coalesce(n, 0) attributes, coalesce(latest_status, 'pending') status, latest_id, priced_id, pp::double last_price, own::double own_price, own is not null selected, case when life = 'not_found' then 'review' else 'active' end state from rule left join i using (rule_id) left join l using (rule_id) left join w using (rule_id) left join f using (rule_id)",
    "wi1_dual_rank": "select obs_id, rule_id, row_number() over (partition by rule_id order by checked_at desc, obs_id desc) place, row_number() over (partition by rule_id order by (status = 'priced') desc, checked_at desc, obs_id desc) priced_place from obs",
    "wi2_segments": "with m as (select *, sum(case when status <> 'priced' or currency <> 'RUB' then 1 else 0 end) over (partition by rule_id order by checked_at, obs_id rows unbounded preceding) segment from obs) select rule_id, obs_id, price::double price, segment::bigint segment from m where status = 'priced' and currency = 'RUB'",
    "wi3_first_last": "with m as (select rule_id, arg_min(price, (checked_at, obs_id))::double a, arg_max(price, (checked_at, obs_id))::double b, count(*) points from obs where status = 'priced' and currency = 'RUB' group by 1) select rule_id, a first_value, b last_value, points, round(case when points > 1 and a <> 0 then (b - a) / a * 100 end, 4) change from m",
    "jo4_as_of_price": "with l as (select l_partkey rule_id, l_orderkey run, l_linenumber line, o_orderdate as day from lineitem join orders on l_orderkey = o_orderkey), c as (select l.rule_id, run, line, max((q.checked_at, q.run_id, q.line_no, q.source_id, q.price, q.basis, q.rate)) m from l left join quote q on l.rule_id = q.rule_id and q.checked_at <= day group by all) select rule_id, run, line, m[2] quote_run, m[3] quote_line from c",
    "jo5_as_of_month": f"with w as (select distinct rule_id, date_trunc('month', checked_at) m from obs where status not in {S}), l as (select rule_id, date_trunc('month', checked_at) m, arg_max(obs_id, (checked_at, obs_id)) obs_id from obs where status in {S} group by all) select rule_id, strftime(m, '%Y-%m') as month, obs_id from w left join l using (rule_id, m)",
    "jo6_confirmed": f"select rule_id, strftime(max(checked_at), '%Y-%m-%d') as day from obs where status in {S} and rule_id in (select rule_id from quote) group by 1",
    "jo7_recent_rules": "select rule_id, manufacturer from rule where rule_id in (select rule_id from obs where checked_at >= '2024-01-15')",
    "jo8_never_checked": f"select rule_id, manufacturer from rule where not exists (select 1 from obs where obs.rule_id = rule.rule_id and status in {S})",
    "jo3_actual_or_reused": "with l as (select rule_id, date_trunc('month', checked_at) m, arg_max(run_id, (checked_at, run_id, line_no, source_id, price, basis, rate)) r from quote where status = 'priced' group by all) select run_id, line_no, case when r is not null then 'already_collected' else status end status, r reused_run_id from quote q left join l on q.rule_id = l.rule_id and date_trunc('month', checked_at) = m where status <> 'priced'",
    "sk4_last_write": "select rule_id, currency, arg_max(obs_id, (checked_at, obs_id)) obs_id, arg_max(status, (checked_at, obs_id)) status from obs group by all",
    "sk5_guarded": f"with m as (select *, strftime(checked_at, '%Y-%m-%d') as day from obs) select rule_id, day, coalesce(arg_min(obs_id, (checked_at, obs_id)) filter (status in {S}), arg_max(obs_id, (checked_at, obs_id))) obs_id, coalesce(arg_min(status, (checked_at, obs_id)) filter (status in {S}), arg_max(status, (checked_at, obs_id))) status from m group by all",
    "sk6_monotonic": f"with m as (select *, case when status = 'priced' then 2 when status in {S} then 1 else 0 end k from obs) select rule_id, arg_max(obs_id, (k, checked_at, obs_id)) obs_id, arg_max(status, (k, checked_at, obs_id)) status from m group by 1",
    "sk9_version_log": "select rule_id, sha256(status || '|' || currency) as version, arg_min(obs_id, (checked_at, obs_id)) obs_id, count(*) sightings from obs group by 1, 2",
    "sk10_supersede": f"with k as (select rule_id, status, max((checked_at, obs_id)) t from obs where status in {S} group by 1, 2) select rule_id, status, case when t = max(t) over (partition by rule_id) then 'confirmed' else 'superseded' end state, t[2] obs_id from k",
    "sk12_revisions": "with o as (select rule_id, obs_id, date_trunc('hour', checked_at) base, count(*) over w n, min(obs_id) over w m from obs window w as (partition by rule_id, date_trunc('hour', checked_at))) select rule_id, obs_id, row_number() over (partition by rule_id order by base) revision, n > 1 conflict from o where obs_id = m",
    "st1_monthly_memory": f"select rule_id, strftime(checked_at, '%Y-%m') as month, arg_min(obs_id, (checked_at, obs_id)) obs_id, count(*) - 1 reused from obs where status in {S} group by 1, 2",
    "st3_stalls": f"with m as (select *, lead(checked_at) over w nxt, first_value(checked_at) over w f, case when status is distinct from lag(status) over w then checked_at end s from obs window w as (partition by rule_id order by checked_at, obs_id)), r as (select *, last_value(case when status in {S} then checked_at end ignore nulls) over v ok, last_value(s ignore nulls) over v since from m window v as (partition by rule_id order by checked_at, obs_id rows unbounded preceding)), c as (select rule_id, obs_id, case when epoch(nxt - checked_at) >= 86400 then 'silent' when epoch(checked_at - coalesce(ok, f)) >= 172800 then 'inactive' when epoch(checked_at - since) >= 259200 then 'same_status' end reason from r) select * from c where reason is not null",
    "st8_carry_forward": f"select rule_id, obs_id, last_value(case when status in {S} then obs_id end ignore nulls) over (partition by rule_id order by checked_at, obs_id rows unbounded preceding) last_success from obs",
    "st9_circuit_breaker": "with m as (select *, (status in ('not_found', 'network_error'))::int f from obs), i as (select *, sum(1 - f) over (partition by rule_id order by checked_at, obs_id rows unbounded preceding) g from m), r as (select *, sum(f) over (partition by rule_id, g order by checked_at, obs_id rows unbounded preceding) n from i) select rule_id, obs_id from r where n = 3 and f = 1",
    "ag16_lifecycle_bootstrap": f"select rule_id, strftime(min(checked_at), '%Y-%m-%d %H:%M:%S') first_seen, strftime(max(checked_at), '%Y-%m-%d %H:%M:%S') last_seen, count(*) checks from obs where status in {S} group by 1",
    "fi6_period": "select obs_id, strftime(checked_at + interval 5 hour, '%Y-%m-%d') as day, last_day((checked_at + interval 5 hour)::date) <= date '2024-01-25' whole_month from obs where (checked_at + interval 5 hour)::date between date '2024-01-05' and date '2024-01-25'",
    "fi8_month_window": f"select status, count(*) n from obs where status in {S} and checked_at >= timestamp '2024-01-01' and checked_at < timestamp '2024-02-01' group by 1",
    "se2_periods": "select strftime(checked_at, '%Y-%m') as period from obs union select strftime(checked_at, '%Y-%m') from quote union select strftime(o_orderdate, '%Y-%m') from orders",
    "jo30_reverify": "with l as (select rule_id, max((checked_at, obs_id)) m, arg_max(status, (checked_at, obs_id)) s, arg_max(coalesce(price, -1), (checked_at, obs_id)) p, arg_max(currency, (checked_at, obs_id)) c from obs group by 1), b as (select o.rule_id, arg_max(price, (checked_at, obs_id)) bp, arg_max(currency, (checked_at, obs_id)) bc from obs o join l on l.rule_id = o.rule_id and (o.checked_at, o.obs_id) < l.m where status = 'priced' group by 1) select rule_id, case when s <> 'priced' then 'unavailable' when p <> bp or c <> bc then 'price_changed' when rule_id % 5 = 0 then 'not_found' else 'confirmed' end state from b join l using (rule_id)",
    "fi19_recheck": "with l as (select rule_id, max(checked_at) t from obs group by 1), q as (select rule_id, arg_max(rate, (checked_at, run_id, line_no, source_id, price, basis, rate)) r from quote where status = 'priced' group by 1) select rule_id, strftime(t, '%Y-%m-%d %H:%M:%S') last_attempt from q left join l using (rule_id) where r = 0 and coalesce(t <= (select max(checked_at) - interval 1 day from obs), true)",
}
