"""Queries over source checks, runs and jobs: coverage, progress, states, differences between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.operators import checks
from quotemill.session import table
from quotemill.sources.views import chk, obs, quote, rule
from quotemill.streaming import catalogue, lifecycle


def jo16_completeness_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every nation and kind of source with its last check, or what stands for none."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("competitor"))
    config = n.select("competitor", F.explode(F.array(*map(F.lit, ("news", "products", "telegram", "promotions")))).alias("kind"))
    return checks.completeness_grid(config, chk(spark, d), ["competitor", "kind"], ["check_id"], ["status", "url"], {"status": "partial", "url": "not yet checked"})


def ag25_coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """By competitor the last status of each kind in columns, and whether anything is incomplete."""
    last = chk(spark, d).groupBy("competitor", "kind").agg(F.max_by("status", "check_id").alias("status"))
    wide = last.groupBy("competitor").pivot("kind", ["news", "products", "telegram"]).agg(F.first("status"))
    partial = F.exists(F.array("news", "products", "telegram"), lambda s: F.coalesce(s, F.lit("partial")) != "success")
    return wide.withColumn("incomplete", partial)


def ag12_coverage_shares(spark: SparkSession, d: str) -> DataFrame:
    return checks.shares(chk(spark, d), "status", ["success", "partial", "error"])


def fi9_monitored(spark: SparkSession, d: str) -> DataFrame:
    """Checks in and out of the monitored nations, nulls counted as out."""
    inside = F.coalesce(F.col("competitor") < "M", F.lit(False))
    return chk(spark, d).groupBy(inside.alias("monitored")).agg(F.count("*").alias("n"))


def ag2_run_totals(spark: SparkSession, d: str) -> DataFrame:
    """Runs with their jobs and finished jobs; runs without jobs stay."""
    jobs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("jobs"), F.count_if(F.col("l_linestatus") == "F").alias("finished"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")).join(jobs, "run_id", "left").select("run_id", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("finished", F.lit(0)).alias("finished"))


def ag4_run_state(spark: SparkSession, d: str) -> DataFrame:
    """cancelled before completed_with_errors before completed; open while a job is."""
    q = quote(spark, d).groupBy("run_id").agg(F.bool_or(F.col("status") == "no_price").alias("errors"), F.bool_or(F.col("basis") == "net").alias("unfinished"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderpriority") == "1-URGENT").alias("cancelled"))
    state = F.when(F.col("unfinished"), "open").when(F.col("cancelled"), "cancelled").when(F.col("errors"), "completed_with_errors").otherwise("completed")
    return o.join(q, "run_id").select("run_id", state.alias("state"))


def ag3_progress(spark: SparkSession, d: str) -> DataFrame:
    """By brand: ten counters of its checks (here: checks in RUB are of product cards, on_request is cached, no_price skipped,
    not_found failed, network_error pending), the last one, and the positions that quotes saved; both sides are added up
    by product before they meet."""
    done, card = F.col("status") != "network_error", F.col("currency") == "RUB"
    counters = {"pages": F.lit(True), "visited": done, "cards": card, "cards_visited": card & done, "monthly_skipped": card & (F.col("status") == "on_request"), "failures": F.col("status") == "not_found", "navigation_left": ~card & ~done, "products_left": card & ~done, "skipped": F.col("status") == "no_price"}
    checks_ = obs(spark, d).groupBy("rule_id").agg(*[F.count_if(c).alias(k) for k, c in counters.items()], F.max("checked_at").alias("t"))
    saved = quote(spark, d).where("status <> 'no_price'").groupBy("rule_id").agg(F.count("*").alias("positions"))
    j = rule(spark, d).select("rule_id", "manufacturer").join(checks_, "rule_id", "left").join(saved, "rule_id", "left").groupBy("manufacturer")
    return j.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in (*counters, "positions")], F.date_format(F.max("t"), "yyyy-MM-dd HH:mm:ss").alias("last_checked"))


def ag1_library_kpis(spark: SparkSession, d: str) -> DataFrame:
    """One row: products, priced products, products with two prices, last check."""
    c = obs(spark, d).groupBy("rule_id").agg(F.count_if(F.col("status") == "priced").alias("prices"), F.max("checked_at").alias("t"))
    j = rule(spark, d).join(c, "rule_id", "left")
    return j.agg(F.count("*").alias("products"), F.count_if(F.col("prices") > 0).alias("priced"), F.count_if(F.col("prices") > 1).alias("compared"), F.date_format(F.max("t"), "yyyy-MM-dd HH:mm:ss").alias("last_check"))


def ag24_operations(spark: SparkSession, d: str) -> DataFrame:
    """Checks by brand and state with the last one; for the brand, the age of its last sign of life in seconds before the
    end of the history and the positions that it saved."""
    o = obs(spark, d)
    end = o.agg(F.max("checked_at").alias("end")).withColumn("k", F.lit(1))
    by = o.groupBy("rule_id", "status").agg(F.count("*").alias("n"), F.max("checked_at").alias("t"))
    by = by.join(rule(spark, d).select("rule_id", "manufacturer"), "rule_id").groupBy("manufacturer", "status").agg(F.sum("n").alias("n"), F.max("t").alias("t"))
    w = Window.partitionBy("manufacturer")  # a row for each state
    by = by.select("manufacturer", "status", "n", "t", F.max("t").over(w).alias("alive"), F.sum(F.when(F.col("status") == "priced", F.col("n")).otherwise(0)).over(w).alias("saved"), F.lit(1).alias("k"))
    return by.join(F.broadcast(end), "k").select("manufacturer", "status", "n", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("last_checked"), F.timestamp_diff("SECOND", F.col("alive"), F.col("end")).alias("age_seconds"), "saved")


def jo9_pending(spark: SparkSession, d: str) -> DataFrame:
    """Open jobs whose source is not handled elsewhere."""
    outside = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("source_id"))
    return quote(spark, d).where("status = 'no_price'").join(outside, "source_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("jobs"))


def jo17_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Products that came or changed between two states of the catalogue."""
    r = rule(spark, d)
    old = r.where("rule_id % 11 <> 0").withColumn("list_price", F.when(F.col("rule_id") % 5 == 0, F.col("list_price") + 1).otherwise(F.col("list_price")))
    return checks.snapshot_diff(old, r.where("rule_id % 13 <> 0"), ["rule_id"], F.sha2(F.concat_ws("|", "title", F.col("list_price").cast("string")), 256))


def se3_selection(spark: SparkSession, d: str) -> DataFrame:
    """Two selections (returned lines, large lines) merged in order, kept to products that exist."""
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("rule_id")).agg(F.min("l_orderkey").alias("at"))
    b = table(spark, d, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("rule_id")).agg(F.min("l_orderkey").alias("at"))
    return checks.ordered_union([a, b], "rule_id", "at").join(rule(spark, d).where("size < 40").select("rule_id"), "rule_id", "left_semi").select("rule_id", F.col("part").cast("long").alias("part"), "at")


def se6_absent_variants(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of a brand's category that another brand's has and it lacks."""
    r = rule(spark, d).select("manufacturer", "category", "size")
    every = r.select("category", "size").distinct()
    brands = r.select("manufacturer", "category").distinct()
    return brands.join(every, "category").join(r, ["manufacturer", "category", "size"], "left_anti").groupBy("manufacturer").agg(F.count("*").alias("absent"))


def se8_absent_brands(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(1, 40).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("manufacturer"))
    return wanted.join(rule(spark, d).select("manufacturer"), "manufacturer", "left_anti")


def ag14_activity(spark: SparkSession, d: str) -> DataFrame:
    """By nation: checks of each kind and all."""
    return chk(spark, d).groupBy("competitor").agg(F.count_if(F.col("kind") == "news").alias("news"), F.count_if(F.col("kind") == "products").alias("products"), F.count("*").alias("total"))


def li4_top_competitors(spark: SparkSession, d: str) -> DataFrame:
    return chk(spark, d).groupBy("competitor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "competitor").limit(5)


def jo29_activity_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a quarter with customer and nation."""
    o = table(spark, d, "orders").where(F.col("o_orderdate").between("1995-01-01", "1995-03-31"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


def st2_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """State of each product after its checks: two absences at least a day apart archive it."""
    return lifecycle.fold(obs(spark, d).select("rule_id", "checked_at", "obs_id", "status")).select("rule_id", "state", "missing", "events")


# --- lifecycle by manifests: a run is a day's checks of a brand; every tenth check reads a listing, the others product pages


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks with source and effect: a price or a word for it is a read card, one without a price may say discontinued;
    what is not found is an address or a variant."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select(F.col("event_id").alias("obs_id"), k.alias("k"))
    o = obs(spark, d).join(e, "obs_id").join(rule(spark, d).select("rule_id", F.col("manufacturer").alias("source")), "rule_id")
    effect = F.when((F.col("status") == "no_price") & (F.col("k") >= 80), "discontinued").when(F.col("status").isin("priced", "on_request", "no_price"), "active").when(F.col("status") == "not_found", F.when(F.col("k") >= 50, "variant").otherwise("http"))
    return o.select("rule_id", "source", F.date_trunc("day", "checked_at").alias("run_id"), F.col("checked_at").alias("at"), "obs_id", effect.alias("effect"), F.when(F.col("k") % 10 == 0, "listing").otherwise("product").alias("kind"), (F.col("status") != "network_error").alias("ok"))


def _states(checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs, and products' states after all checks."""
    runs = catalogue.manifests(checks)
    products = checks.select("rule_id", "source").distinct()
    listed = checks.where("kind = 'product'")
    return runs, catalogue.fold(catalogue.gated(checks, runs).union(catalogue.unlisted(products, listed, runs)))


def st2_manifest_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """State of each product after its checks, where only complete runs of its brand tell of absence."""
    return _states(_checks(spark, d))[1]


def _moved(spark: SparkSession, d: str, checks: DataFrame) -> DataFrame:
    """Products of an even number as known cards, of an odd one as newly found; an old address that last answered "on
    request" leads to the card of the next number, one that was not found is gone."""
    r = rule(spark, d).select("rule_id", F.col("manufacturer").alias("source"), F.col("title").alias("brand"), F.col("category").alias("article"))
    address = lambda x: F.concat(F.lit("https://shop.example/"), x.cast("string"))
    known = r.where("rule_id % 2 = 0").withColumn("url", address(F.col("rule_id")))
    cards = r.where("rule_id % 2 = 1").withColumnRenamed("rule_id", "card_id").withColumn("url", address(F.col("card_id")))
    last = obs(spark, d).groupBy("rule_id").agg(F.max_by(F.struct("status", "http_status"), F.struct("checked_at", "obs_id")).alias("x"))
    fetches = last.select(address(F.col("rule_id")).alias("url"), F.col("x.http_status").alias("status"), address(F.col("rule_id") + F.when(F.col("x.status") == "on_request", 1).otherwise(0)).alias("target"))
    aliases = quote(spark, d).where("line_no = 1").select(F.col("rule_id"), address(F.col("source_id")).alias("url")).distinct()
    return catalogue.moved(cards, known, aliases, fetches)


def jo24_moved_cards(spark: SparkSession, d: str) -> DataFrame:
    """New cards of a brand, title and category that exactly one known product has, with what shows that it moved."""
    return _moved(spark, d, _checks(spark, d)).select("card_id", "rule_id", "evidence")


def co8_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's catalogue after its runs: complete runs, products by state, events, and new cards that are moved ones."""
    checks = _checks(spark, d)
    runs, states = _states(checks)
    done = runs.groupBy("source").agg(F.count("*").alias("runs"), F.count_if("complete").alias("complete_runs"))
    by = states.join(checks.select("rule_id", "source").distinct(), "rule_id").groupBy("source").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("active", "discontinued", "review", "archived", "new")], F.sum("events").alias("events"))
    new = rule(spark, d).where("rule_id % 2 = 1").select(F.col("rule_id").alias("card_id"), F.col("manufacturer").alias("source"))
    found = new.join(_moved(spark, d, checks), "card_id", "left").groupBy("source").agg(F.count("evidence").alias("moved"), F.count_if(F.col("evidence").isNull()).alias("own_cards"))
    return done.join(by, "source").join(found, "source", "left").fillna(0)


_LIFECYCLE = """b as (select o.rule_id, r.manufacturer as source, date_trunc('day', o.checked_at) run_id, o.checked_at as t, o.obs_id, o.status, json_extract_string(e.props, '$.k')::int k from obs o join events e on e.event_id = o.obs_id join rule r on r.rule_id = o.rule_id),
  runs as (select source, run_id, count_if(k % 10 = 0) > 0 and count_if(k % 10 <> 0) > 0 and count_if(k % 10 = 0 and status = 'network_error') = 0 complete, max(t) closed from b group by 1, 2),
  g as (select rule_id, t, obs_id, case when status = 'no_price' and k >= 80 then 'discontinued' when status in ('priced', 'on_request', 'no_price') then 'active' when status = 'not_found' and complete then case when k >= 50 then 'variant' else 'http' end end effect from b join runs using (source, run_id)
    union all select p.rule_id, closed, 9223372036854775807, 'unlisted' from (select distinct rule_id, source from b) p join runs on runs.source = p.source and complete where not exists (select 1 from b where b.rule_id = p.rule_id and b.run_id = runs.run_id and k % 10 <> 0)),
  o as (select rule_id, epoch_us(t) ts, effect, row_number() over (partition by rule_id order by t, obs_id) n from g where effect is not null),
  f as (select distinct rule_id, 0::bigint n, 'new' state, 0 missing, '' kind, -4000000000000000000::bigint last, 0 events from o
    union all select f.rule_id, o.n,
      case when effect in ('active', 'discontinued') then effect when f.state = 'new' or ts - f.last < 86400000000 then f.state when effect = 'unlisted' then case when f.state = 'archived' then f.state else 'review' end when f.kind = effect and f.missing >= 1 then 'archived' else 'review' end,
      case when effect in ('active', 'discontinued') then 0 when f.state = 'new' or ts - f.last < 86400000000 or effect = 'unlisted' then f.missing when f.kind = effect then f.missing + 1 else 1 end,
      case when effect in ('active', 'discontinued') then '' when f.state = 'new' or ts - f.last < 86400000000 or effect = 'unlisted' then f.kind else effect end,
      case when effect in ('active', 'discontinued') then -4000000000000000000 when f.state = 'new' or ts - f.last < 86400000000 or effect = 'unlisted' then f.last else ts end,
      f.events + case when effect in ('active', 'discontinued') then (f.state in ('new', 'archived'))::int when f.state = 'new' or ts - f.last < 86400000000 or effect = 'unlisted' then 0 else 1 end
    from f join o on o.rule_id = f.rule_id and o.n = f.n + 1),
  states as (select rule_id, arg_max(state, n) state, arg_max(missing, n) missing, arg_max(kind, n) kind, arg_max(events, n) events from f group by 1)"""
_MOVED = """kn as (select manufacturer, title, category, min(rule_id) rule_id from rule where rule_id % 2 = 0 group by 1, 2, 3 having count(*) = 1),
  la as (select rule_id, arg_max(status, (checked_at, obs_id)) status from obs group by 1),
  mv as (select c.rule_id card_id, kn.rule_id, case when exists (select 1 from quote q where q.line_no = 1 and q.rule_id = kn.rule_id and q.source_id = c.rule_id) then 'alias' when la.status = 'on_request' and c.rule_id = kn.rule_id + 1 then 'redirect' when la.status = 'not_found' then 'gone' end evidence
    from rule c join kn using (manufacturer, title, category) left join la on la.rule_id = kn.rule_id where c.rule_id % 2 = 1)"""

QUERIES = {f.__name__: f for f in (jo16_completeness_grid, ag25_coverage_matrix, ag12_coverage_shares, fi9_monitored, ag2_run_totals, ag4_run_state, ag3_progress, ag1_library_kpis, ag24_operations, jo9_pending, jo17_snapshot_diff, se3_selection, se6_absent_variants, se8_absent_brands, ag14_activity, li4_top_competitors, jo29_activity_join, st2_lifecycle, st2_manifest_lifecycle, jo24_moved_cards, co8_reconciled)}
SQL = {
    "jo16_completeness_grid": "with l as (select competitor, kind, arg_max(status, check_id) s, arg_max(url, check_id) u from chk group by 1, 2), g as (select n_name competitor, k.kind from nation, (values ('news'), ('products'), ('telegram'), ('promotions')) k(kind)) select competitor, kind, coalesce(s, 'partial') status, coalesce(u, 'not yet checked') url from g left join l using (competitor, kind)",
    "ag25_coverage_matrix": "with l as (select competitor, kind, arg_max(status, check_id) s from chk group by 1, 2), w as (select competitor, max(s) filter (kind = 'news') news, max(s) filter (kind = 'products') products, max(s) filter (kind = 'telegram') telegram from l group by 1) select *, not (coalesce(news, '') = 'success' and coalesce(products, '') = 'success' and coalesce(telegram, '') = 'success') incomplete from w",
    "ag12_coverage_shares": "with b as (select * from (values ('success'), ('partial'), ('error'), ('other')) b(status)), c as (select case when status in ('success', 'partial', 'error') then status else 'other' end status, count(*) n from chk group by 1) select status, coalesce(n, 0) n, round(coalesce(n, 0) / (select count(*) from chk), 6) as share from b left join c using (status)",
    "fi9_monitored": "select coalesce(competitor < 'M', false) monitored, count(*) n from chk group by 1",
    "ag2_run_totals": "select o_orderkey run_id, count(l_orderkey) jobs, coalesce(count_if(l_linestatus = 'F'), 0) finished from orders left join lineitem on o_orderkey = l_orderkey group by 1",
    "ag4_run_state": "select run_id, case when bool_or(basis = 'net') then 'open' when any_value(o_orderpriority) = '1-URGENT' then 'cancelled' when bool_or(status = 'no_price') then 'completed_with_errors' else 'completed' end state from quote join orders on run_id = o_orderkey group by 1",
    "ag3_progress": "with p as (select rule_id, count(*) pages, count_if(status <> 'network_error') visited, count_if(currency = 'RUB') cards, count_if(currency = 'RUB' and status <> 'network_error') cards_visited, count_if(currency = 'RUB' and status = 'on_request') monthly_skipped, count_if(status = 'not_found') failures, count_if(currency <> 'RUB' and status = 'network_error') navigation_left, count_if(currency = 'RUB' and status = 'network_error') products_left, count_if(status = 'no_price') skipped, max(checked_at) t from obs group by 1), q as (select rule_id, count(*) positions from quote where status <> 'no_price' group by 1) select manufacturer, coalesce(sum(pages), 0) pages, coalesce(sum(visited), 0) visited, coalesce(sum(cards), 0) cards, coalesce(sum(cards_visited), 0) cards_visited, coalesce(sum(monthly_skipped), 0) monthly_skipped, coalesce(sum(failures), 0) failures, coalesce(sum(navigation_left), 0) navigation_left, coalesce(sum(products_left), 0) products_left, coalesce(sum(skipped), 0) skipped, coalesce(sum(positions), 0) positions, strftime(max(t), '%Y-%m-%d %H:%M:%S') last_checked from rule left join p using (rule_id) left join q using (rule_id) group by 1",
    "ag1_library_kpis": "with c as (select rule_id, count_if(status = 'priced') p, max(checked_at) t from obs group by 1) select count(*) products, count_if(p > 0) priced, count_if(p > 1) compared, strftime(max(t), '%Y-%m-%d %H:%M:%S') last_check from rule left join c using (rule_id)",
    "ag24_operations": "with c as (select manufacturer, status, checked_at from obs join rule using (rule_id)), b as (select manufacturer, max(checked_at) alive, count_if(status = 'priced') saved from c group by 1) select manufacturer, status, count(*) n, strftime(max(checked_at), '%Y-%m-%d %H:%M:%S') last_checked, floor(epoch((select max(checked_at) from obs) - any_value(alive)))::bigint age_seconds, any_value(saved) saved from c join b using (manufacturer) group by 1, 2",
    "jo9_pending": "select source_id, count(*) jobs from quote where status = 'no_price' and source_id not in (select s_suppkey from supplier where s_acctbal < 0) group by 1",
    "jo17_snapshot_diff": "select rule_id, case when rule_id % 11 = 0 then 'added' else 'changed' end change from rule where rule_id % 13 <> 0 and (rule_id % 11 = 0 or rule_id % 5 = 0)",
    "se3_selection": "with u as (select l_partkey rule_id, 0 p, min(l_orderkey) k from lineitem where l_returnflag = 'R' group by 1 union all select l_partkey, 1, min(l_orderkey) from lineitem where l_quantity >= 45 group by 1) select rule_id, min(p)::bigint part, arg_min(k, (p, k)) as \"at\" from u where rule_id in (select rule_id from rule where size < 40) group by 1",
    "se6_absent_variants": "with e as (select distinct category, size from rule), b as (select distinct manufacturer, category from rule) select manufacturer, count(*) absent from b join e using (category) where not exists (select 1 from rule r where r.manufacturer = b.manufacturer and r.category = b.category and r.size = e.size) group by 1",
    "se8_absent_brands": "select 'Brand#' || i manufacturer from range(1, 40) t(i) where 'Brand#' || i not in (select manufacturer from rule)",
    "ag14_activity": "select competitor, count_if(kind = 'news') news, count_if(kind = 'products') products, count(*) total from chk group by 1",
    "li4_top_competitors": "select competitor, count(*) n from chk group by 1 order by n desc, competitor limit 5",
    "jo29_activity_join": "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderdate between date '1995-01-01' and date '1995-03-31'",
    "st2_lifecycle": """with recursive k as (select rule_id, status, epoch(checked_at) ts, row_number() over (partition by rule_id order by checked_at, obs_id) n from obs where status in ('priced', 'on_request', 'no_price', 'not_found')),
  f as (select distinct rule_id, 0::bigint n, 'new' state, 0 missing, -1e18::double last, 0 events from k
  union all select f.rule_id, k.n, case when k.status <> 'not_found' then 'active' when k.ts - f.last < 86400 then f.state when f.missing >= 1 then 'archived' else 'review' end,
    case when k.status <> 'not_found' then 0 when k.ts - f.last < 86400 then f.missing else f.missing + 1 end, case when k.status <> 'not_found' then -1e18 when k.ts - f.last < 86400 then f.last else k.ts end,
    f.events + case when k.status <> 'not_found' then (f.state <> 'active')::int when k.ts - f.last < 86400 then 0 when f.missing >= 1 then (f.state <> 'archived')::int else (f.state <> 'review')::int end from f join k on k.rule_id = f.rule_id and k.n = f.n + 1)
  select rule_id, arg_max(state, n) state, arg_max(missing, n) missing, arg_max(events, n) events from f group by 1""",
    "st2_manifest_lifecycle": f"with recursive {_LIFECYCLE} select * from states",
    "jo24_moved_cards": f"with {_MOVED} select * from mv",
    "co8_reconciled": f"""with recursive {_LIFECYCLE}, {_MOVED}, d as (select source, count(*) runs, count_if(complete) complete_runs from runs group by 1),
  s as (select source, count_if(state = 'active') active, count_if(state = 'discontinued') discontinued, count_if(state = 'review') review, count_if(state = 'archived') archived, count_if(state = 'new') as new, sum(events)::bigint events from states join (select distinct rule_id, source from b) using (rule_id) group by 1),
  m as (select manufacturer source, count(evidence) moved, count_if(evidence is null) own_cards from rule left join mv on card_id = rule.rule_id where rule.rule_id % 2 = 1 group by 1)
  select d.*, s.* exclude (source), coalesce(moved, 0) moved, coalesce(own_cards, 0) own_cards from d join s using (source) left join m using (source)""",
}
