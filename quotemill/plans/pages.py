"""Queries over stored pages: URLs, links, classes, robots rules, visible text, quality."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import urls
from quotemill.sources.views import page

LINK = r'(?is)<a\s[^>]*href="([^"]*)"'


def fn31_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


def fn35_dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d).groupBy(urls.dedupe_key(F.col("url")).alias("url_key")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def fn36_identity(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d).select("page_id", urls.identity(F.col("url")).alias("x")).select("page_id", "x.*")


def fn32_paged_url(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d).select("page_id", urls.paged(F.col("url")).alias("catalogue_url"))


def fn33_memory_key(spark: SparkSession, d: str) -> DataFrame:
    """Pages under their canonical address: the first of each is new, the others are remembered."""
    p = page(spark, d).select("page_id", urls.canonical(F.col("url")).alias("memory_key"))
    return p.withColumn("state", F.when(F.row_number().over(Window.partitionBy("memory_key").orderBy("page_id")) == 1, "pending").otherwise("cached"))


def sc8_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link of every page with the number of times it is there."""
    links = page(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


#: By the end of a host: where its catalogue lies, what the rest of a product's path is like, and its page parameter.
STRATEGIES = (("example.com", "/en/", "^[0-9]+/?$", "page"), ("example.net", "/de/", "^[1-9][0-9]*$", "page"), ("example.org", "/", "^[a-z]{2}/[0-9]+/?$", "ref"))


def fi10_url_class(spark: SparkSession, d: str) -> DataFrame:
    """sitemap, listing, product or none, by the rules of the host; a host without rules has none."""
    rules = spark.createDataFrame(STRATEGIES, "site string, prefix string, product string, parameter string")
    x = page(spark, d).select(urls.identity(F.col("url")).alias("x")).select("x.host", "x.path", "x.query", F.regexp_extract("x.host", r"([^.]+\.[^.]+)$", 1).alias("site"))
    j = x.join(F.broadcast(rules), "site", "left")
    inside = F.startswith("path", "prefix")
    kind = F.when(F.col("prefix").isNull(), "none").when(F.col("path").rlike(r"sitemap.*\.xml$"), "sitemap").when(inside & F.concat(F.lit("&"), F.col("query")).contains(F.concat(F.lit("&"), F.col("parameter"), F.lit("="))), "listing")
    kind = kind.when(inside & F.regexp_like(F.expr("substring(path, length(prefix) + 1)"), F.col("product")), "product").otherwise("none")
    return j.groupBy("host", kind.alias("kind")).agg(F.count("*").alias("n"))


#: Paths of listings, and parts of a path that no article has.
LISTING_PATHS = ("news", "articles", "new-products", "text-news")
UTILITY_PARTS = ("cart", "basket", "checkout", "account", "login", "search", "contact", "contacts", "privacy", "policy", "terms", "catalog", "product", "products", "collection", "productcomparison", "product-returns", "returns")


def fi11_article_url(spark: SparkSession, d: str, section: str = "fr", excluded: tuple[str, ...] = ("page=", "utm_source=feed")) -> DataFrame:
    """Pages whose path is neither empty, a listing, the section itself nor has a utility part, and whose address holds no
    excluded text."""
    path = F.btrim(F.lower(urls.identity(F.col("url"))["path"]), F.lit("/"))
    x = page(spark, d).select("page_id", "url", path.alias("path"))
    out = x.where((F.col("path") != "") & ~F.col("path").isin(*LISTING_PATHS, section) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, UTILITY_PARTS))))
    return out.where(~reduce(or_, [F.contains(F.lower("url"), F.lit(e)) for e in excluded])).select("page_id")


def fi12_robots(spark: SparkSession, d: str) -> DataFrame:
    """The longest rule that matches a page's path decides, Allow wins ties, no rule allows."""
    rules = spark.createDataFrame([("/en/", False), ("/en/1", True), ("/*?page=", False), ("/de/2*5$", False), ("/fr/", True)], "rule string, allow boolean")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("rule", r"([.?+()\[\]{}|^])", r"\\$1"), r"\*", ".*"), r"\$$", "\\$"))
    rules = rules.select(F.lit(1).alias("k"), "rule", "allow", pattern.alias("pattern"), F.length("rule").alias("size"))
    table = rules.groupBy("k").agg(F.collect_list(F.struct("size", "allow", "pattern")).alias("rules"))
    x = urls.identity(F.col("url"))
    asked = page(spark, d).select("page_id", F.lit(1).alias("k"), F.concat(x["path"], F.when(x["query"] != "", F.concat(F.lit("?"), x["query"])).otherwise("")).alias("target"))
    asked = asked.join(F.broadcast(table), "k")  # one row: the rules of a host
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.regexp_like(F.col("target"), r["pattern"])), lambda r: F.struct(r["size"], r["allow"])))
    return asked.select("page_id", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


#: What pages say that are not there, not to be read, or did not load.
MISSING_TITLES = ("not found", "page not found", "404", "404 not found", "страница не найдена")
MISSING_TEXTS = ("resource you are looking for does not exist", "resource you are looking for doesn't exist", "ресурс, который вы ищете, не существует")
BLOCK_TITLES = ("just a moment", "один момент", "403 forbidden", "access denied")
ERROR_TEXTS = ("sorry, something went wrong when loading the data", "generated by cloudfront", "выполнение проверки безопасности")


def page_states(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> page_id, state: why a page is of no use, the first reason that holds: its body has under 40
    characters and a script, its title or a heading (or a sentence) says that it is missing, its title that access is
    blocked, its text that loading failed; else, and without HTML, ok."""
    plain = lambda c: F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), r"\s+", " ")))
    html = F.coalesce("html", F.lit(""))
    says = lambda c, words: reduce(or_, [c.contains(w) for w in words])
    x = pages.select("page_id", html.alias("html"), plain(html).alias("text"), plain(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), plain(F.regexp_extract(html, "(?is)<body[^>]*>(.*)</body>", 1)).alias("body"), F.transform(F.regexp_extract_all(html, F.lit("(?is)<h1[^>]*>(.*?)</h1>"), 1), plain).alias("headings"))
    empty = F.col("html").rlike("(?i)<body") & (F.length("body") < 40) & F.col("html").rlike("(?i)<script[^>]* src=|<app-root|<webx-root")
    missing = F.array(*map(F.lit, MISSING_TITLES))
    state = F.when(empty, "not_loaded").when(F.array_contains(missing, F.col("title")) | F.arrays_overlap(missing, F.col("headings")) | says(F.col("text"), MISSING_TEXTS), "not_found")
    return x.select("page_id", state.when(says(F.col("title"), BLOCK_TITLES), "blocked").when(says(F.col("text"), ERROR_TEXTS), "load_error").otherwise("ok").alias("state"))


def fi16_page_quality(spark: SparkSession, d: str) -> DataFrame:
    return page_states(page(spark, d))


def fn50_headings(spark: SparkSession, d: str) -> DataFrame:
    """First heading and title of each page, entities and tags as they stand."""
    return page(spark, d).select("page_id", F.regexp_extract("html", r"(?is)<h1[^>]*>([^<]*)</h1>", 1).alias("heading"), F.regexp_extract("html", r"(?is)<title>([^<]*)</title>", 1).alias("title"))


class _Visible(HTMLParser):
    """Text outside script, style and head."""

    hidden = frozenset({"script", "style", "head", "noscript", "template"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.links = 0, [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden
        self.links += tag == "a" and any(k == "href" for k, _ in attrs)

    def handle_endtag(self, tag):
        self.depth -= tag in self.hidden and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def _visible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for page_id, html in zip(frame.page_id, frame.html, strict=True):
            parser = _Visible()
            parser.feed(html or "")
            parser.close()
            text = " ".join(" ".join(parser.parts).split())
            out.append((page_id, text, len(text), parser.links))
        yield pd.DataFrame(out, columns=["page_id", "visible", "chars", "links"])


def fn50_visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of each page, from a parser in each task."""
    return page(spark, d).select("page_id", "html").mapInPandas(_visible, "page_id long, visible string, chars long, links long")


def fn54_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Links by kind of file."""
    links = page(spark, d).select(F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("href"))
    kind = F.lower(F.regexp_extract("href", r"(\.[A-Za-z0-9]{2,4})$", 1))
    return links.groupBy(F.when(kind == "", "page").otherwise(kind).alias("kind")).agg(F.count("*").alias("n"))


def ag17_manifest(spark: SparkSession, d: str) -> DataFrame:
    """By host: navigation and product pages, and whether the manifest is complete."""
    x = urls.identity(F.col("url"))
    p = page(spark, d).select(x["host"].alias("host"), x["query"].contains("page=").alias("listing"), (F.length("html") < 1500).alias("incomplete"))
    out = p.groupBy("host").agg(F.count_if("listing").alias("navigation"), F.count_if(~F.col("listing")).alias("products"), F.count_if("incomplete").alias("incomplete"))
    return out.withColumn("complete", (F.col("navigation") > 0) & (F.col("products") > 0) & (F.col("incomplete") == 0))


def li5_next_work(spark: SparkSession, d: str) -> DataFrame:
    """By host the next page to work on: products before listings, then by address."""
    x = urls.identity(F.col("url"))
    p = page(spark, d).select(x["host"].alias("host"), "page_id", "url", F.when(x["query"].contains("page="), 1).otherwise(0).alias("priority"))
    return p.groupBy("host").agg(F.min_by("page_id", F.struct("priority", "url", "page_id")).alias("page_id"))


def jo20_official_first(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose address is no earlier page's, with and without query."""
    p = page(spark, d).withColumn("key", urls.dedupe_key(F.col("url")))
    official, media = p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1")
    return official.select("page_id", F.lit("official").alias("origin")).union(media.join(official.select("key"), "key", "left_anti").select("page_id", F.lit("media")))


HOST = r"regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)"
PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
LINKS = r"""select page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"', 1)) href from page"""
QUERIES = {f.__name__: f for f in (fn31_canonical_url, fn35_dedupe_key, fn36_identity, fn32_paged_url, fn33_memory_key, sc8_links, fi10_url_class, fi11_article_url, fi12_robots, fi16_page_quality, fn50_headings, fn50_visible_text, fn54_attachments, ag17_manifest, li5_next_work, jo20_official_first)}
CANON = r"""(select page_id, lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^([A-Za-z]+://[^/]*)', 1)) || coalesce(nullif(regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[A-Za-z]+://[^/]*', ''), '/+$', ''), ''), '/')
  || case when len(k) > 0 then '?' || array_to_string(k, '&') else '' end as canonical from (select page_id, url, list_sort(list_filter(string_split(regexp_extract(split_part(url, '#', 1), '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)='))) k from page))"""


def _plain(x: str) -> str:
    return rf"trim(lower(regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"


def _says(x: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w.replace(chr(39), 2 * chr(39))}')" for w in words) + ")"


SQL = {
    "fn31_canonical_url": f"select page_id, canonical from {CANON}",
    "fn35_dedupe_key": "select lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '')) url_key, count(*) pages, min(page_id) first_page from page group by 1",
    "fn36_identity": rf"select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) scheme, lower({HOST}) host, case when starts_with(lower(url), 'https') then 443 else 80 end port, {PATH} as path, {QUERY} as query from page",
    "fn32_paged_url": r"select page_id, case when regexp_extract(url, '[?&]page=([^&#]*)', 1) = '' then b when regexp_matches(regexp_extract(url, '[?&]page=([^&#]*)', 1), '^[1-9][0-9]*$') then b || '?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) end catalogue_url from (select *, 'https://' || regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^[A-Za-z]+://', '') b from page)",
    "fn33_memory_key": f"select page_id, canonical memory_key, case when row_number() over (partition by canonical order by page_id) = 1 then 'pending' else 'cached' end state from {CANON}",
    "sc8_links": f"select page_id, href, count(*) n from ({LINKS}) group by 1, 2",
    "fi10_url_class": rf"""with x as (select lower({HOST}) host, {PATH} p, {QUERY} q from page), r(site, prefix, product, parameter) as (values {", ".join(map(str, STRATEGIES))}) select host, case when prefix is null then 'none' when regexp_matches(p, 'sitemap.*\.xml$') then 'sitemap' when starts_with(p, prefix) and contains('&' || q, '&' || parameter || '=') then 'listing' when starts_with(p, prefix) and regexp_matches(substr(p, length(prefix) + 1), product) then 'product' else 'none' end kind, count(*) n from x left join r on regexp_extract(host, '([^.]+\.[^.]+)$', 1) = site group by 1, 2""",
    "fi11_article_url": f"with x as (select page_id, url, trim(lower({PATH}), '/') p from page) select page_id from x where p <> '' and p not in {(*LISTING_PATHS, 'fr')} and not list_has_any(string_split(p, '/'), {list(UTILITY_PARTS)}) and not contains(lower(url), 'page=') and not contains(lower(url), 'utm_source=feed')",
    "fi12_robots": rf"with t as (select page_id, {PATH} || case when {QUERY} <> '' then '?' || {QUERY} else '' end g from page), r(a, p, s) as (values (false, '^/en/', 4), (true, '^/en/1', 5), (false, '^/.*\?page=', 8), (false, '^/de/2.*5$', 8), (true, '^/fr/', 4)) select page_id, coalesce(arg_max(a, (s, a)), true) allowed from t left join r on regexp_matches(g, p) group by 1",
    "fi16_page_quality": f"""with h as (select page_id, coalesce(html, '') html from page), t as (select page_id, html, {_plain("html")} x, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} title, {_plain("regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)")} body, list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda v: {_plain("v")}) headings from h)
  select page_id, case when regexp_matches(html, '(?i)<body') and length(body) < 40 and regexp_matches(html, '(?i)<script[^>]* src=|<app-root|<webx-root') then 'not_loaded' when title in {MISSING_TITLES} or list_has_any(headings, {list(MISSING_TITLES)}) or {_says("x", MISSING_TEXTS)} then 'not_found' when {_says("title", BLOCK_TITLES)} then 'blocked' when {_says("x", ERROR_TEXTS)} then 'load_error' else 'ok' end state from t""",
    "fn50_headings": "select page_id, regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1) heading, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) title from page",
    "fn54_attachments": rf"select case when k = '' then 'page' else k end kind, count(*) n from (select lower(regexp_extract(href, '(\.[A-Za-z0-9]{{2,4}})$', 1)) k from ({LINKS})) group by 1",
    "ag17_manifest": f"select lower({HOST}) host, count_if(contains({QUERY}, 'page=')) navigation, count_if(not contains({QUERY}, 'page=')) products, count_if(length(html) < 1500) incomplete, count_if(contains({QUERY}, 'page=')) > 0 and count_if(not contains({QUERY}, 'page=')) > 0 and count_if(length(html) < 1500) = 0 complete from page group by 1",
    "li5_next_work": f"select lower({HOST}) host, arg_min(page_id, (contains({QUERY}, 'page=')::int, url, page_id)) page_id from page group by 1",
    "jo20_official_first": "with p as (select page_id, lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '')) k from page) select page_id, 'official' origin from p where page_id % 2 = 0 union all select page_id, 'media' from p where page_id % 2 = 1 and k not in (select k from p where page_id % 2 = 0)",
}
