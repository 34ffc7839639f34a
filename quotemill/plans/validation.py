"""Queries over imported rows and translations: valid rows and faults by line, released files, kept tokens.

The imports are written from the given tables (``TASKS``, ``ITEMS``, ``TRANSLATED``: expressions that both engines take),
with faults of every kind among them; the queries read only what is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import text as t
from quotemill.operators import validation as v
from quotemill.session import table

#: Price tasks, one for each line of an order, over lineitem, part and the nation of the brand.
TASKS = {
    "file": "concat('f', l_suppkey)",
    "line": "l_orderkey * 10 + l_linenumber",
    "source": "case when p_size = 7 then 'nowhere' when l_linenumber % 4 = 0 then concat(' ', lower(n_name)) when l_linenumber % 4 = 1 then concat(lower(n_name), '.EXAMPLE') when l_linenumber % 4 = 2 then concat('Shop ', n_name) else n_name end",
    "manufacturer": "case when p_size = 11 then 'Noname' when l_linenumber % 2 = 0 then concat(upper(substr(p_brand, 1, 5)), ' - ', substr(p_brand, 7)) else p_brand end",
    "article": "case when p_size = 13 then ' ' when p_size = 17 then '=1+1' when p_size = 18 then repeat('A', 151) when p_size = 20 then null else concat('A', l_partkey) end",
    "product_url": "case when p_size = 29 then 'https://x.example/1' when l_linenumber % 3 = 0 then null when p_size = 19 then concat('https://', lower(n_name), '.example.evil.test/p') when p_size = 41 then concat('http://', lower(n_name), '.example/p/', l_partkey) else concat('https://', case when p_size = 23 then 'www.' else '' end, lower(n_name), '.example/p/', l_partkey) end",
    "url_template": "case when l_linenumber % 3 <> 0 then '' when p_size = 31 then concat('https://', lower(n_name), '.example/{x}/{article}') when p_size = 37 then concat('https://', lower(n_name), '.example/p') when p_size = 43 then concat('https://', lower(n_name), '.example/', repeat('x', 2048), '{article}') else concat('https://', lower(n_name), '.example/p/{article}') end",
}
_BRANDS = "cast(substr(p_brand, 7) as int) % 25"
#: Research items, one for each order.
ITEMS = {
    "run": "case when o_orderkey % 503 = 0 then 'lost' else substr(cast(o_orderdate as string), 1, 7) end",
    "line": "o_orderkey",
    "competitor": "concat('c', o_custkey % 27)",
    "published": "case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then concat(substr(cast(o_orderdate as string), 1, 7), '-31') when o_orderkey % 7 = 0 then substr(cast(o_orderdate as string), 1, 7) when o_orderkey % 19 = 0 then '1991-02-03' else substr(cast(o_orderdate as string), 1, 10) end",
    "precision": "case when o_orderkey % 13 = 0 then case when o_orderkey % 2 = 0 then 'unknown' else 'day' end when o_orderkey % 7 = 0 and o_orderkey % 17 <> 0 then 'month' else 'day' end",
    "basis": "case when o_orderkey % 23 = 0 then ' ' else 'heading' end",
    "url": "case when o_orderkey % 29 = 0 then 'ftp://example.org' else concat('https://Example.org/news/', o_custkey, '/', o_totalprice > 250000, '/') end",
    "proof_url": "case when o_orderkey % 53 = 0 then 'none' when o_orderkey % 31 = 0 then concat('https://example.org/other/', o_custkey) else concat('https://example.org/news/', o_custkey, '/', o_totalprice > 250000, '#top') end",
    "quote": "case when o_orderkey % 37 = 0 then '' when o_orderkey % 41 = 0 then concat('order ', o_custkey, ' of ', o_orderpriority, '!') else concat('order   ', o_custkey, ' of ', o_orderpriority) end",
    "snapshot": "case when o_orderkey % 43 = 0 then null else concat('The order ', o_custkey, '  of ', o_orderpriority, ' was ', o_orderstatus) end",
    "status": "case when o_orderstatus = 'F' then 'verified' when o_orderkey % 47 = 0 then 'draft' else 'candidate' end",
}
#: A text of each product and its translation.
ORIGINAL = "concat('Inductive proximity sensor IME', p_size, '-04BPS: range ', p_size, ',5 mm, ', p_size, '.5 mm at 24 VDC, 10 %')"
TRANSLATED = "case p_partkey % 6 when 0 then concat('Индуктивный бесконтактный датчик IME', p_size, '-04BPS: зона ', p_size, '.5 mm, ', p_size, '.5 mm при 24 VDC, 10%') when 1 then concat('Индуктивный датчик приближения IME', p_size, '-04BPN: зона ', p_size, ',5 mm, ', p_size, '.5 mm при 24 VDC, 10 %') when 2 then concat('Датчик бесконтактный IME', p_size, '-04BPS: зона ', p_size, '.5 mm при 24 VDC, 10 %') when 3 then concat('Индуктивный датчик: ', p_size, ' мм') when 4 then '' else null end"


def co14_task_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every task with its address, its first fault and whether its file is released."""
    nation, part, line = (table(spark, d, n) for n in ("nation", "part", "lineitem"))
    branded = part.join(nation, F.expr(_BRANDS) == F.col("n_nationkey"))
    tasks = line.join(branded, F.col("l_partkey") == F.col("p_partkey")).select(*[F.expr(x).alias(n) for n, x in TASKS.items()])
    sources = branded.select(F.lower("n_name").alias("source"), F.concat(F.lower("n_name"), F.lit(".example")).alias("host"), F.concat(F.lit("Shop "), "n_name").alias("label"), F.col("p_brand").alias("brand")).distinct()
    return v.validated_tasks(tasks, sources).select("file", "line", "source", "manufacturer", F.sha2("url", 256).alias("url_sha256"), "code", "released")


def co12_item_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every research item with its id, its codes and whether its run is released."""
    orders = table(spark, d, "orders")
    found = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 33).cast("int"))
    items = orders.select(*[F.expr(x).alias(n) for n, x in ITEMS.items()], found.alias("discovered"))
    month = F.trunc("o_orderdate", "month")
    runs = orders.select(F.date_format(month, "yyyy-MM").alias("run"), F.date_format(month, "yyyy-MM").alias("period"), month.cast("timestamp").alias("started"), F.date_add(month, 60).cast("timestamp").alias("finished")).distinct()
    competitors = table(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("competitor"))
    return v.validated_items(items, runs, competitors)


def fn60_translations(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that translations lose or add, each as often as it lacks or exceeds, and terms that they miss."""
    faults = t.translation_faults(F.expr(ORIGINAL), F.expr(TRANSLATED))
    return table(spark, d, "part").select("p_partkey", faults.alias("x")).select("p_partkey", *[F.array_join(F.array_sort(f"x.{n}"), " ").alias(n) for n in ("lost", "added", "terms")])


QUERIES = {q.__name__: q for q in (co14_task_rows, co12_item_rows, fn60_translations)}


def _columns(exprs: dict[str, str]) -> str:
    return ", ".join(f'{x} "{n}"' for n, x in exprs.items())


_TOKENS = r"list_concat(regexp_extract_all({0}, '\b[A-ZА-Я]+[A-ZА-Я0-9-]*\d[A-ZА-Я0-9-]*\b|\b[A-Z]{{2,}}[A-Z0-9-]*\b'), list_transform(regexp_extract_all({0}, '\d+(?:[.,]\d+)?(?:\s*[%°])?'), lambda n: replace(replace(n, ',', '.'), ' ', '')), regexp_extract_all({0}, '\b(?:mm|VDC)\b'))"
_PAGE = r"lower(regexp_replace(regexp_replace({}, '#.*$', ''), '/$', ''))"
SQL = {
    "co14_task_rows": rf"""with b as (select * from part join nation on {_BRANDS} = n_nationkey),
s as (select distinct lower(n_name) source, lower(n_name) || '.example' host, lower('Shop ' || n_name) label, p_brand brand from b),
k as (select {_columns(TASKS)} from lineitem join b on l_partkey = p_partkey),
x as (select file, line, trim(source) src, trim(manufacturer) maker, trim(coalesce(article, '')) article, trim(coalesce(product_url, '')) product_url, trim(coalesce(url_template, '')) tpl from k),
n as (select x.*, h.source id, h.host, br.brand, case when product_url <> '' then product_url else replace(tpl, '{{article}}', article) end url from x
  left join (select distinct source, host, label from s) h on lower(src) in (h.source, h.host, h.label)
  left join s br on br.source = h.source and upper(regexp_replace(br.brand, '[^A-Za-z0-9]', '', 'g')) = upper(regexp_replace(maker, '[^A-Za-z0-9]', '', 'g'))),
c as (select file, line, coalesce(id, src) source, coalesce(brand, maker) manufacturer, article, url, case when id is null then 'unknown_source' when brand is null then 'unknown_brand'
  when article = '' or length(article) > 150 or left(article, 1) in ('=', '+', '@') then 'article' when (product_url <> '') = (tpl <> '') then 'one_address'
  when tpl <> '' and (len(string_split(tpl, '{{article}}')) <> 2 or regexp_matches(replace(tpl, '{{article}}', ''), '[{{}}]')) then 'template' when length(url) > 2048 then 'long_address'
  when not starts_with(url, 'https://') or not (split_part(split_part(url, '//', 2), '/', 1) = host or ends_with(split_part(split_part(url, '//', 2), '/', 1), '.' || host)) then 'address' end fault from n),
r as (select *, coalesce(fault, case when line > min(case when fault is null then line end) over (partition by file, source, manufacturer, article, url) then 'repeated' end) code from c)
select file, line, source, manufacturer, sha256(url) url_sha256, code, count(code) over (partition by file) = 0 released from r""",
    "co12_item_rows": rf"""with i as (select {_columns(ITEMS)}, o_orderdate + to_days(cast(o_orderkey % 33 as int)) discovered from orders),
r as (select distinct strftime(o_orderdate, '%Y-%m') run_id, date_trunc('month', o_orderdate) started from orders),
x as (select i.*, run_id is not null there, started, coalesce(case precision when 'day' then try_strptime(published, '%Y-%m-%d') is not null when 'month' then length(published) = 7 else published is null end, false) dated,
  {_PAGE.format("url")} page, {_PAGE.format("proof_url")} proof_page, regexp_replace(trim(quote), ' +', ' ', 'g') q, regexp_replace(trim(coalesce(snapshot, '')), ' +', ' ', 'g') snap from i left join r on run = run_id),
f as (select run, line, sha256(competitor || chr(10) || page) item_id, case when not there then 'run' else concat_ws(',', case when cast(substr(competitor, 2) as int) > 24 then 'competitor' end, case when not dated then 'date' end,
  case when dated and left(published, 7) <> run then 'period' end, case when dated and published is not null and trim(basis) = '' then 'basis' end, case when not starts_with(url, 'http') then 'url' end, case when not starts_with(proof_url, 'http') then 'proof' end,
  case when discovered not between started and started + interval 60 day then 'instant' end, case when status = 'draft' then 'status' end,
  case when status = 'verified' then concat_ws(',', case when q = '' then 'quote' end, case when page <> proof_page then 'other_page' end, case when snap = '' then 'snapshot' when q <> '' and not contains(snap, q) then 'unproven' end) end) end c from x),
g as (select run, line, item_id, case when rtrim(c, ',') = '' and line > min(case when rtrim(c, ',') = '' then line end) over (partition by run, item_id) then 'repeated' else rtrim(c, ',') end codes from f)
select run, line, item_id, codes, count(nullif(codes, '')) over (partition by run) = 0 released from g""",
    "fn60_translations": rf"""with p as (select p_partkey, lower({ORIGINAL}) low, coalesce(lower({TRANSLATED}), '') ru, {_TOKENS.format(ORIGINAL)} a, {_TOKENS.format(f"coalesce({TRANSLATED}, '')")} b from part),
n as (select p_partkey, w, sum(d) d from (select p_partkey, unnest(a) w, 1 d from p union all select p_partkey, unnest(b), -1 from p) group by all),
m as (select p_partkey, trim(coalesce(string_agg(trim(repeat(w || ' ', cast(d as int))), ' ' order by w) filter (where d > 0), '')) lost, trim(coalesce(string_agg(trim(repeat(w || ' ', cast(-d as int))), ' ' order by w) filter (where d < 0), '')) added from n group by all)
select p_partkey, lost, added, concat_ws(' ', case when low like '%inductive%' and ru not like '%индуктивн%' then 'inductive' end, case when low like '%proximity%' and ru not like '%приближен%' and ru not like '%бесконтакт%' then 'proximity' end) terms from p join m using (p_partkey)""",
}
