"""Queries over dates as publishers write them: parsers, evidence by tier, look-ups by several keys, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import dates, urls
from quotemill.session import table
from quotemill.sources.views import obs, page, quote, rule


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"))


def _word(names: tuple[str, ...], month) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), month)


def fn38_publisher_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in six ways, read back; texts without a date, or with a day that isn't, give none."""
    o, day, k = _orders(spark, d), F.col("day"), F.col("id") % 8
    russian = F.concat_ws(" ", F.dayofmonth("day").cast("string"), _word(dates.GENITIVE, F.month("day")), F.year("day").cast("string"))
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm"))
        .when(k == 1, F.date_format(day, "'Дата:' yyyy.MM.dd"))
        .when(k == 2, F.date_format(day, "d.MM.yyyy"))
        .when(k == 3, russian)
        .when(k == 4, F.date_format(day, "MMMM d, yyyy"))
        .when(k == 5, F.date_format(day, "d MMM yyyy"))
        .when(k == 6, F.concat(F.lit("model 18x1 "), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("31.02."), F.year("day").cast("string")))
    )
    return o.select("id", dates.parse_date(text).cast("string").alias("parsed"))


def fn39_announced_month(spark: SparkSession, d: str) -> DataFrame:
    """The month that a text announces: named once or twice, or two different ones."""
    o, k = _orders(spark, d).withColumn("day", F.add_months("day", 360)), F.col("id") % 3  # announcements are of this century
    named = F.concat_ws(" ", _word(dates.NOMINATIVE, F.month("day")), F.year("day").cast("string"))
    later = F.concat_ws(" ", _word(dates.NOMINATIVE, F.month(F.add_months("day", 1))), F.year(F.add_months("day", 1)).cast("string"))
    text = F.when(k == 0, F.concat(F.lit("Выйдет: "), named)).when(k == 1, F.concat(named, F.lit(", повторно "), named)).otherwise(F.concat(named, F.lit(" или "), later))
    return o.select("id", dates.announced_month(text).cast("string").alias("month"))


def fn40_periods(spark: SparkSession, d: str) -> DataFrame:
    """By customer: the months from the first to the last order, their number and a label."""
    o = _orders(spark, d).groupBy("customer").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    return o.select("customer", F.size(months).cast("long").alias("months"), dates.month_key(F.element_at(months, -1)).alias("last_key"), F.concat(F.date_format("a", "MM.yyyy"), F.lit("–"), F.date_format("b", "MM.yyyy")).alias("label"))


def fn41_local_time(spark: SparkSession, d: str) -> DataFrame:
    """Checks in Yekaterinburg's time, as labels."""
    return obs(spark, d).select("obs_id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Yekaterinburg"), F.col("checked_at").cast("timestamp_ntz")), "dd.MM.yyyy HH:mm").alias("label"))


def fn42_partial_dates(spark: SparkSession, d: str) -> DataFrame:
    """Errors of dates of a day, a month or a year that are filed under a month."""
    o, k = _orders(spark, d), F.col("id")
    precision = F.when(k % 3 == 0, "day").when(k % 3 == 1, "month").otherwise("year")
    value = F.when(k % 10 == 0, "2026/1").when(k % 3 == 0, F.when(k % 7 == 0, F.concat(F.date_format("day", "yyyy-MM"), F.lit("-32"))).otherwise(F.date_format("day", "yyyy-MM-dd"))).when(k % 3 == 1, F.date_format("day", "yyyy-MM")).otherwise(F.date_format("day", "yyyy"))
    period = F.when(k % 11 == 0, F.date_format(F.add_months("day", 14), "yyyy-MM")).otherwise(F.date_format("day", "yyyy-MM"))
    return o.select("id", precision.alias("precision"), dates.partial_date_error(precision, value, period).alias("error")).groupBy("precision", "error").agg(F.count("*").alias("n"))


def fi7_month_containment(spark: SparkSession, d: str) -> DataFrame:
    """Events in a range of days; one that is known by its month only needs the whole month inside."""
    day, month_only = F.col("checked_at").cast("date"), F.col("obs_id") % 4 == 0
    inside = F.when(month_only, dates.month_inside(day, "2024-01-10", "2024-03-31")).otherwise(day.between(F.lit("2024-01-10").cast("date"), F.lit("2024-03-31").cast("date")))
    return obs(spark, d).where(inside).groupBy(F.when(month_only, "month").otherwise("day").alias("precision")).agg(F.count("*").alias("n"), F.min("obs_id").alias("first_id"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """By product and tier of evidence (tax rate here): how many different days are named, the day, and all of them."""
    q = quote(spark, d).where("status = 'priced' and rate <= 3").groupBy("rule_id", F.col("rate").alias("tier"))
    out = q.agg(F.array_sort(F.collect_set(F.col("checked_at").cast("date").cast("string"))).alias("days"))
    grid = rule(spark, d).select("rule_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tier"))
    out = grid.join(out, ["rule_id", "tier"], "left")
    state = F.when(F.col("days").isNull(), "missing").when(F.size("days") == 1, "verified").otherwise("ambiguous")
    return out.select("rule_id", "tier", state.alias("state"), F.when(F.size("days") == 1, F.element_at("days", 1)).alias("day"), F.coalesce(F.array_join("days", "; "), F.lit("")).alias("evidence"))


def ag7_date_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Different candidate days of each tier: none is missing, one is verified, more are ambiguous."""
    return _evidence(spark, d)


def fn52_date_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first tier that has evidence decides, even where it is ambiguous."""
    first = F.min_by(F.struct("tier", "state", "day"), F.when(F.col("state") != "missing", F.col("tier")))
    out = _evidence(spark, d).groupBy("rule_id").agg(first.alias("x"))
    return out.select("rule_id", F.col("x.tier").cast("long").alias("tier"), F.coalesce("x.state", F.lit("missing")).alias("state"), "x.day")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the keys by which a listing may know them, by priority, and the day that even pages give."""
    x = urls.identity(F.col("url"))
    slug = F.element_at(F.split(x["path"], "/"), -1)
    keys = F.array(F.struct(F.lit(0).alias("priority"), F.concat(F.lit("url:"), F.col("url")).alias("key")), F.struct(F.lit(1).alias("priority"), F.concat(F.lit("path:"), x["path"]).alias("key")), F.struct(F.lit(2).alias("priority"), F.concat(F.lit("slug:"), slug).alias("key")))
    day = F.when(F.col("page_id") % 2 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")))
    return page(spark, d).select("page_id", day.alias("day"), F.explode(keys).alias("k")).select("page_id", "day", "k.priority", "k.key")


def jo14_multi_key_dates(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a day take the first verified one by address, path or slug; a key seen with two days is void."""
    keys = _keys(spark, d)
    known = keys.where("day is not null").groupBy("key").agg(F.min("day").alias("least"), F.max("day").alias("most")).where("least = most").select("key", F.col("least").alias("found"))
    asked = keys.where("day is null").join(known, "key", "left").groupBy("page_id").agg(F.min_by(F.struct("priority", "found"), F.when(F.col("found").isNotNull(), F.col("priority"))).alias("x"))
    return asked.select("page_id", F.element_at(F.create_map(*[F.lit(v) for v in (0, "url", 1, "path", 2, "slug")]), F.col("x.priority")).alias("by_key"), F.col("x.found").cast("string").alias("day"))


def co11_date_audit(spark: SparkSession, d: str) -> DataFrame:
    """Pages by how their day is known: their own, by which key, or not at all."""
    own = page(spark, d).where("page_id % 2 = 0").select(F.lit("own").alias("outcome"))
    return own.union(jo14_multi_key_dates(spark, d).select(F.coalesce("by_key", F.lit("missing")))).groupBy("outcome").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (fn38_publisher_dates, fn39_announced_month, fn40_periods, fn41_local_time, fn42_partial_dates, fi7_month_containment, ag7_date_consensus, fn52_date_cascade, jo14_multi_key_dates, co11_date_audit)}

_EVIDENCE = "v as (select r.rule_id, t.tier, count(distinct q.checked_at::date) n, min(q.checked_at::date)::varchar a, string_agg(distinct q.checked_at::date::varchar, '; ' order by q.checked_at::date::varchar) e from rule r cross join (values (0), (1), (2), (3)) t(tier) left join quote q on q.rule_id = r.rule_id and q.rate = t.tier and q.status = 'priced' group by 1, 2), w as (select rule_id, tier, case n when 0 then 'missing' when 1 then 'verified' else 'ambiguous' end state, case when n = 1 then a end as day, coalesce(e, '') evidence from v)"
_PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_LOOKUP = f"p as (select page_id, case when page_id % 2 = 0 then date '2024-01-01' + (page_id % 28)::int end as day, url, {_PATH} path from page), k as (select page_id, day, 0 pr, 'url:' || url as key from p union all select page_id, day, 1, 'path:' || path from p union all select page_id, day, 2, 'slug:' || string_split(path, '/')[-1] from p), s as (select key, min(day) f from k where day is not null group by 1 having min(day) = max(day)), a as (select page_id, arg_min(pr, pr) filter (f is not null) pr, arg_min(f, pr) filter (f is not null) f from k left join s using (key) where day is null group by 1), j as (select page_id, case pr when 0 then 'url' when 1 then 'path' when 2 then 'slug' end by_key, f::varchar as day from a)"
SQL = {
    "fn38_publisher_dates": "select o_orderkey id, case when o_orderkey % 8 < 6 then o_orderdate::date::varchar end parsed from orders",
    "fn39_announced_month": "select o_orderkey id, case when o_orderkey % 3 < 2 then date_trunc('month', o_orderdate + interval 30 year)::date::varchar end as month from orders",
    "fn40_periods": "select o_custkey customer, date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 as months, strftime(max(o_orderdate), '%Y-%m') last_key, strftime(min(o_orderdate), '%m.%Y') || '–' || strftime(max(o_orderdate), '%m.%Y') as label from orders group by 1",
    "fn41_local_time": "select obs_id, strftime(checked_at + interval 5 hour, '%d.%m.%Y %H:%M') as label from obs",
    "fn42_partial_dates": "with t as (select o_orderkey k, case o_orderkey % 3 when 0 then 'day' when 1 then 'month' else 'year' end as precision, (k % 11 = 0) moved, o_orderdate m from orders) select precision, case when k % 10 = 0 then 'precision' when precision = 'day' and k % 7 = 0 then 'date' when moved and (precision <> 'year' or strftime(m, '%Y') <> strftime(m + interval 14 month, '%Y')) then 'period' end error, count(*) n from t group by 1, 2",
    "fi7_month_containment": "select case when obs_id % 4 = 0 then 'month' else 'day' end as precision, count(*) n, min(obs_id) first_id from obs where case when obs_id % 4 = 0 then date_trunc('month', checked_at) >= date '2024-01-10' and last_day(checked_at) <= date '2024-03-31' else checked_at::date between date '2024-01-10' and date '2024-03-31' end group by 1",
    "ag7_date_consensus": f"with {_EVIDENCE} select * from w",
    "fn52_date_cascade": f"with {_EVIDENCE} select rule_id, min(tier) filter (state <> 'missing') tier, coalesce(arg_min(state, tier) filter (state <> 'missing'), 'missing') state, (arg_min(coalesce(day, ''), tier) filter (state <> 'missing')) as d0, nullif(d0, '') as day from w group by 1",
    "jo14_multi_key_dates": f"with {_LOOKUP} select * from j",
    "co11_date_audit": f"with {_LOOKUP} select coalesce(by_key, 'missing') outcome, count(*) n from (select by_key from j union all select 'own' from page where page_id % 2 = 0) group by 1",
}
SQL["fn52_date_cascade"] = f"with {_EVIDENCE}, c as (select rule_id, min(tier) filter (state <> 'missing') tier from w group by 1) select c.rule_id, c.tier::bigint tier, coalesce(w.state, 'missing') state, w.day from c left join w on w.rule_id = c.rule_id and w.tier = c.tier"
