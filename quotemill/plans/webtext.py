"""Queries over what pages say: main text, cards, product fields, quotes, sitemaps, acceptance of articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import text as t
from quotemill.functions import urls
from quotemill.sources.views import doc, page, post, quote, rule

ANCHOR = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
#: Words that announce a product, and words that only promote (fixed values).
ANNOUNCES = r"(?iU)\b(new|launch(?:es|ed)?|introduc(?:es|ed|ing)|unveils|nouvelle|neue)\b"
PROMOTES = r"(?iU)\b(sale|discount|promo|soldes|rabatt)\b"


#: What a product is called, and how one is announced before or after it (fixed values).
PRODUCT = r"(?:датчик\w*|преобразовател\w*|кнопк\w*|серия|серии|sensor\w*|encoder\w*|controller\w*|series|flow meter\w*|code.read\w*)"
NEWS = (
    r"(?:\bnew\b|\bupgraded\b|\bнов(?:ый|ая|ые|ую|ых)\b)\s+(?:[\w-]+\s+){0,4}" + PRODUCT,
    r"\b(?:launch(?:es|ed)?|introduc(?:es|ed|ing)|unveils)\s+(?:[\w-]+\s+){0,6}" + PRODUCT,
    r"\b(?:portfolio|lineup|series|range)\b.{0,45}\b(?:expanded|additional|upgraded|added)\b",
    r"(?:расшир\w*|обнов\w*|пополн\w*)\s+(?:[\w-]+\s+){0,2}(?:линейк\w*|ассортимент\w*|сери\w*)",
)
#: Titles of pages that ask whether a visitor is a person, and what their first characters hold (fixed values).
CHALLENGE_TITLE = "just a moment|access denied|checking your browser|verify.*human|captcha|доступ ограничен|проверка браузера|подтвердите.*человек"
CHALLENGE_BODY, CHALLENGE_COOKIE = "cf-chl-", r"""document\.cookie\s*=\s*[\x22\x27]RCPC="""


def announces_product(title: Column, text: Column) -> Column:
    """Whether a title with the first 200 characters of its text announces a product or a larger range of them."""
    subject = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(F.coalesce(text, F.lit("")), F.lit(200))))
    said = reduce(lambda x, y: x | y, [subject.rlike(f"(?U){p}") for p in NEWS])
    return said | (subject.rlike(r"(?U)\bновинки\b") & subject.rlike(f"(?U){PRODUCT}"))


def is_challenge(html: Column) -> Column:
    """Whether a page is a visitor check, by its title or its first 20 000 characters."""
    head = F.left(html, F.lit(20_000))
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(title.rlike(CHALLENGE_TITLE) | F.contains(head, F.lit(CHALLENGE_BODY)) | head.rlike(f"(?i){CHALLENGE_COOKIE}"), F.lit(False))


def _without_tags(html: Column) -> Column:
    return t.squeezed(F.regexp_replace(html, "(?is)<[^>]*>", " "))


def _main(html: Column) -> Column:
    """The article without its advertisements; the whole body where there is no article."""
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(article != "", article).otherwise(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1))
    return _without_tags(F.regexp_replace(body, r'(?is)<div class="ad">.*?</div>', " "))


def _title(html: Column) -> Column:
    return t.squeezed(F.regexp_extract(html, r"(?is)<title>([^<]*)</title>", 1))


def fn51_main_text(spark: SparkSession, d: str) -> DataFrame:
    """The main text of each page, by length and fingerprint."""
    main = _main(F.col("html"))
    return page(spark, d).select("page_id", main.alias("main")).select("page_id", F.length("main").cast("long").alias("chars"), F.sha2("main", 256).alias("fingerprint"))


def fn53_listing_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a page's listing: address, title, and how often the page shows them."""
    cards = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("title"))
    x = page(spark, d).select("page_id", F.explode(cards).alias("c"))
    names = x.schema["c"].dataType.fieldNames()
    return x.groupBy("page_id", F.col(f"c.`{names[0]}`").alias("href"), F.col(f"c.`{names[1]}`").alias("title")).agg(F.count("*").alias("n"))


def sc7_product_cards(spark: SparkSession, d: str) -> DataFrame:
    """A product card from each page: number and language from the address, maker from the host, name, and variants (bold names)."""
    x = urls.identity(F.col("url"))
    number = F.nullif(F.regexp_extract(x["path"], r"/(\d+)$", 1), F.lit("")).cast("long")
    bold = F.regexp_extract_all("html", F.lit(r"(?is)<b>([^<]*)"), F.lit(1))
    return page(spark, d).select("page_id", number.alias("article"), F.regexp_extract(x["path"], "^/([a-z]{2})/", 1).alias("language"), F.regexp_extract(x["host"], r"([^.]+)\.example\.[a-z]+$", 1).alias("maker"), t.squeezed(F.regexp_extract("html", r"(?is)<h1[^>]*>([^<]*)</h1>", 1)).alias("name"), F.size(bold).cast("long").alias("variants"))


def fn55_site_attributes(spark: SparkSession, d: str) -> DataFrame:
    """By site (the host without its first label): pages, languages, paragraphs, and those with a footer that names the host."""
    x = urls.identity(F.col("url"))["host"]
    footer = F.regexp_extract("html", r"(?is)<footer>(.*?)</footer>", 1)
    p = page(spark, d).select(F.regexp_extract(x, r"([^.]+\.example\.[a-z]+)$", 1).alias("site"), F.regexp_extract("html", r'(?is)<html lang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit("(?i)(<p>)"), F.lit(1))).alias("paragraphs"), F.contains(footer, x).alias("named"))
    return p.groupBy("site").agg(F.count("*").alias("pages"), F.count_distinct("lang").alias("languages"), F.sum("paragraphs").alias("paragraphs"), F.count_if("named").alias("named"))


def fn56_quote_proof(spark: SparkSession, d: str) -> DataFrame:
    """Whether a quoted title, squeezed and in lower case, stands in the page's main text; every fifth quote is altered."""
    quoted = F.lower(F.concat(_title(F.col("html")), F.when(F.col("page_id") % 5 == 0, F.lit(" xq")).otherwise("")))
    return page(spark, d).select("page_id", F.contains(F.lower(_main(F.col("html"))), quoted).alias("proven"))


def fn58_announcements(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose beginning announces something, and those that only promote."""
    start = F.left(t.squeezed(F.col("text")), F.lit(200))
    return doc(spark, d).groupBy(start.rlike(ANNOUNCES).alias("announces"), start.rlike(PROMOTES).alias("promotes")).agg(F.count("*").alias("n"))


def fn59_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Articles confirmed, or the reason against them; a later check overrides an earlier one."""
    x, k = urls.identity(F.col("url")), F.col("page_id")
    reason = F.when(k % 7 == 0, "missing_date")
    reason = F.when(k % 11 == 0, "future_date").otherwise(reason)
    reason = F.when(x["host"].startswith("m."), "host").otherwise(reason)
    reason = F.when(x["query"].contains("page="), "listing").otherwise(reason)
    reason = F.when(F.length(_main(F.col("html"))) < 600, "content").otherwise(reason)
    return page(spark, d).groupBy(F.coalesce(reason, F.lit("confirmed")).alias("outcome")).agg(F.count("*").alias("n"))


def fi17_challenge(spark: SparkSession, d: str) -> DataFrame:
    """Pages that ask whether a visitor is a person; among the given ones some are served a check by title, by a mark in the
    first characters, by a mark too far behind to count, or by a cookie, chosen by the length of the page."""
    n = F.length("html") % 7
    served = F.when(n == 0, F.regexp_replace("html", "(?is)<title>[^<]*</title>", "<title>Just a moment...</title>")).when(n == 1, F.concat(F.lit("<i class='cf-chl-x'>"), "html")).when(n == 2, F.concat("html", F.lpad(F.lit("cf-chl-"), 20_000, " "))).when(n == 3, F.concat(F.lit("<script>Document.cookie = 'RCPC=1'</script>"), "html")).otherwise(F.col("html"))
    return page(spark, d).where(is_challenge(served)).select("page_id")


def fn58_product_news(spark: SparkSession, d: str) -> DataFrame:
    """Titles and texts about products of the catalogue, in the words of news, offers and reports, with whether they announce
    a product."""
    said = ["{} launches the new compact {} sensor", "{} introduces a large {} for the shop", "{}: our {} range has additional sizes", "{}: {} sensors at a discount", "{} обновила популярную линейку {}", "Новинки {}: датчики {}", "Новый завод {} и {}", "{} upgraded its small and light {} encoders"]
    text = lambda i: F.format_string(said[i].replace("{}", "%s"), "manufacturer", "title")
    r = rule(spark, d).withColumn("news", F.element_at(F.array(*[text(i) for i in range(len(said))]), F.col("size") % len(said) + 1))
    return r.select("rule_id", announces_product(F.col("news"), F.col("category")).alias("announces"))


def fn34_crawl_urls(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages as addresses to crawl: made absolute, other schemes and files left out, tracking removed."""
    x = urls.identity(F.col("url"))
    links = page(spark, d).select(F.concat(x["scheme"], F.lit("://"), x["host"]).alias("root"), F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    full = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("root", "href"))
    return links.select(full.alias("u")).where(F.col("u").isNotNull() & ~urls.is_asset(F.col("u"))).groupBy(urls.canonical(F.col("u")).alias("address")).agg(F.count("*").alias("n"))


def fn37_templates(spark: SparkSession, d: str) -> DataFrame:
    """Search addresses of products by the template of a site."""
    return rule(spark, d).select("rule_id", urls.expand(F.lit("https://site.example/search?q={article}&p=1"), F.concat_ws(" ", "manufacturer", "title")).alias("address"))


def fn44_semantic_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of quotes that differ in what they say, not in when or by whom they were seen."""
    version = F.sha2(F.concat_ws("|", F.col("price").cast("string"), "basis", F.col("rate").cast("string"), "status"), 256)
    return quote(spark, d).groupBy("rule_id").agg(F.count_distinct(version).alias("versions"), F.count("*").alias("sightings"))


def fn45_composite_keys(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).select("rule_id", F.sha2(F.concat_ws("\n", "manufacturer", "category", F.col("rule_id").cast("string")), 256).alias("rule_key"))


def fn47_portable_events(spark: SparkSession, d: str) -> DataFrame:
    """Posts as portable events: a derived id, who, and a title of at most 60 characters."""
    title = t.shortened(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 60)
    return post(spark, d).select(F.sha2(F.concat_ws(":", F.col("channel").cast("string"), F.col("post_id").cast("string")), 256).alias("event_id"), F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown")).alias("author"), title.alias("title"))


def sc9_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """Addresses from the sitemaps of hosts; one with a document type is rejected before it is parsed."""
    x = urls.identity(F.col("url"))["host"]
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = page(spark, d).groupBy(x.alias("host")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("body"))
    head = F.when(F.col("host").startswith("m."), F.lit("<!DOCTYPE urlset>")).otherwise("")
    maps = maps.select("host", F.concat(head, F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml")).where(~F.col("xml").rlike("(?i)<!(?:DOCTYPE|ENTITY)"))
    return maps.select("host", F.explode(F.xpath("xml", F.lit("/urlset/url/loc/text()"))).alias("address")).groupBy("host", "address").agg(F.count("*").alias("n"))


def sc10_feed(spark: SparkSession, d: str) -> DataFrame:
    """Entries of feeds in a range of days that are not known yet, a feed for each source of documents."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd")
    item = F.concat(F.lit("<item><guid>"), F.col("doc_id").cast("string"), F.lit("</guid><date>"), day, F.lit("</date></item>"))
    feeds = doc(spark, d).groupBy("source").agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(item), ""), F.lit("</rss>")).alias("xml"))
    entries = feeds.select("source", F.explode(F.arrays_zip(F.xpath("xml", F.lit("/rss/item/guid/text()")).alias("guid"), F.xpath("xml", F.lit("/rss/item/date/text()")).alias("day"))).alias("e"))
    a, b = entries.schema["e"].dataType.fieldNames()
    entries = entries.select("source", F.col(f"e.`{a}`").cast("long").alias("doc_id"), F.col(f"e.`{b}`").alias("day"))
    known = doc(spark, d).where("doc_id % 5 = 0").select("doc_id")
    return entries.where(F.col("day").between("2024-01-10", "2024-01-31")).join(known, "doc_id", "left_anti").select("source", "doc_id", "day")


def sc11_channel_pages(spark: SparkSession, d: str) -> DataFrame:
    """Posts read back from channel pages, and how the page covers them: a message without text makes it partial."""
    body = F.concat(F.lit('<div data-post="'), F.col("post_id").cast("string"), F.lit('"><p>'), F.sha2("text", 256), F.lit("</p></div>"))
    pages = post(spark, d).groupBy("channel").agg(F.array_join(F.collect_list(F.when(F.col("post_id") % 13 == 5, F.concat(F.lit('<div data-post="'), F.col("post_id").cast("string"), F.lit('"></div>'))).otherwise(body)), "").alias("html"))
    form = F.lit(r'<div data-post="(\d+)">(?:<p>([^<]*)</p>)?</div>')
    ids, texts = F.regexp_extract_all("html", form, F.lit(1)), F.regexp_extract_all("html", form, F.lit(2))
    x = pages.select("channel", F.size(ids).cast("long").alias("posts"), F.size(F.filter(texts, lambda s: s == "")).cast("long").alias("invalid"), F.array_max(F.transform(ids, lambda i: i.cast("long"))).alias("last_post"))
    return x.withColumn("coverage", F.when(F.col("invalid") > 0, "partial").otherwise("success"))


QUERIES = {f.__name__: f for f in (fn51_main_text, fn53_listing_cards, sc7_product_cards, fn55_site_attributes, fn56_quote_proof, fn58_announcements, fn59_acceptance, fi17_challenge, fn58_product_news, fn34_crawl_urls, fn37_templates, fn44_semantic_versions, fn45_composite_keys, fn47_portable_events, sc9_sitemaps, sc10_feed, sc11_channel_pages)}


def _sq(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0b\x85\p{{Z}}]+', ' ', 'g'))"


_MAIN = _sq(r"""regexp_replace(regexp_replace(case when regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) <> '' then regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) else regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) end, '(?is)<div class="ad">.*?</div>', ' ', 'g'), '(?is)<[^>]*>', ' ', 'g')""")
_TITLE = _sq("regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)")
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_START = "left(" + _sq("coalesce(text, '')") + ", 200)"
SQL = {
    "fn51_main_text": f"select page_id, length({_MAIN}) chars, sha256({_MAIN}) fingerprint from page",
    "fn53_listing_cards": r"""with a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) title from page) select page_id, href, title, count(*) n from a group by 1, 2, 3""",
    "sc7_product_cards": rf"select page_id, nullif(regexp_extract({_PATH}, '/(\d+)$', 1), '')::bigint article, regexp_extract({_PATH}, '^/([a-z]{{2}})/', 1) as language, regexp_extract({_HOST}, '([^.]+)\.example\.[a-z]+$', 1) maker, " + _sq("regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)") + " as name, len(regexp_extract_all(html, '(?is)<b>([^<]*)', 1)) variants from page",
    "fn55_site_attributes": rf"""select regexp_extract({_HOST}, '([^.]+\.example\.[a-z]+)$', 1) site, count(*) pages, count(distinct regexp_extract(html, '(?is)<html lang="([^"]*)"', 1)) languages, sum(len(regexp_extract_all(html, '(?i)(<p>)', 1)))::bigint paragraphs, count_if(contains(regexp_extract(html, '(?is)<footer>(.*?)</footer>', 1), {_HOST})) named from page group by 1""",
    "fn56_quote_proof": f"select page_id, contains(lower({_MAIN}), lower({_TITLE} || case when page_id % 5 = 0 then ' xq' else '' end)) proven from page",
    "fn58_announcements": rf"select regexp_matches({_START}, '(?i)\b(new|launch(?:es|ed)?|introduc(?:es|ed|ing)|unveils|nouvelle|neue)\b') announces, regexp_matches({_START}, '(?i)\b(sale|discount|promo|soldes|rabatt)\b') promotes, count(*) n from doc group by 1, 2",
    "fn59_acceptance": rf"select case when length({_MAIN}) < 600 then 'content' when contains(regexp_extract(url, '\?([^#]*)', 1), 'page=') then 'listing' when starts_with({_HOST}, 'm.') then 'host' when page_id % 11 = 0 then 'future_date' when page_id % 7 = 0 then 'missing_date' else 'confirmed' end outcome, count(*) n from page group by 1",
    "fi17_challenge": r"""with s as (select page_id, case length(html) % 7 when 0 then regexp_replace(html, '(?is)<title>[^<]*</title>', '<title>Just a moment...</title>', 'g') when 1 then '<i class=''cf-chl-x''>' || html when 2 then html || lpad('cf-chl-', 20000, ' ') when 3 then '<script>Document.cookie = ''RCPC=1''</script>' || html else html end h from page)
  select page_id from s where regexp_matches(lower(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)), 'just a moment|access denied|checking your browser|verify.*human|captcha') or contains(left(h, 20000), 'cf-chl-') or regexp_matches(left(h, 20000), '(?i)document\.cookie\s*=\s*[\x22\x27]RCPC=')""",
    "fn58_product_news": r"""with t as (select rule_id, ' ' || lower([manufacturer || ' launches the new compact ' || title || ' sensor', manufacturer || ' introduces a large ' || title || ' for the shop', manufacturer || ': our ' || title || ' range has additional sizes', manufacturer || ': ' || title || ' sensors at a discount', manufacturer || ' обновила популярную линейку ' || title, 'Новинки ' || manufacturer || ': датчики ' || title, 'Новый завод ' || manufacturer || ' и ' || title, manufacturer || ' upgraded its small and light ' || title || ' encoders'][size % 8 + 1] || ' ' || category) || ' ' s from rule)
  select rule_id, regexp_matches(s, '[^\p{L}\d_](new|upgraded|нов(ый|ая|ые|ую|ых))\s+([\p{L}\d_-]+\s+){0,4}(датчик|преобразовател|кнопк|серия|серии|sensor|encoder|controller|series|flow meter|code.read)') or regexp_matches(s, '[^\p{L}\d_](launch(es|ed)?|introduc(es|ed|ing)|unveils)\s+([\p{L}\d_-]+\s+){0,6}(датчик|преобразовател|кнопк|серия|серии|sensor|encoder|controller|series|flow meter|code.read)') or regexp_matches(s, '[^\p{L}\d_](portfolio|lineup|series|range)[^\p{L}\d_](.{0,44}[^\p{L}\d_])?(expanded|additional|upgraded|added)[^\p{L}\d_]')
    or regexp_matches(s, '(расшир|обнов|пополн)[\p{L}\d_]*\s+([\p{L}\d_-]+\s+){0,2}(линейк|ассортимент|сери)') or (regexp_matches(s, '[^\p{L}\d_]новинки[^\p{L}\d_]') and regexp_matches(s, '(датчик|преобразовател|кнопк|серия|серии|sensor|encoder|controller|series|flow meter|code.read)')) announces from t""",
    "fn34_crawl_urls": rf"""with l as (select lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {_HOST} root, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"', 1)) href from page), u as (select case when regexp_matches(href, '^https?://') then href when starts_with(href, '/') then root || href end u from l) select regexp_replace(u, '/+$', '') as address, count(*) n from u where u is not null and not regexp_matches(lower(regexp_extract(u, '^([^?#]*)', 1)), '\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|mp4|zip|pdf)$') group by 1""",
    "fn37_templates": "select rule_id, 'https://site.example/search?q=' || replace(replace(manufacturer || ' ' || title, '#', '%23'), ' ', '%20') || '&p=1' as address from rule",
    "fn44_semantic_versions": "select rule_id, count(distinct (price, basis, rate, status)) versions, count(*) sightings from quote group by 1",
    "fn45_composite_keys": "select rule_id, sha256(manufacturer || chr(10) || category || chr(10) || rule_id) rule_key from rule",
    "fn47_portable_events": "select sha256(channel || ':' || post_id) event_id, coalesce(nullif(role, ''), 'unknown') author, case when length(split_part(text, chr(10), 1)) > 60 then rtrim(left(split_part(text, chr(10), 1), 59)) || '…' else split_part(text, chr(10), 1) end title from post",
    "sc9_sitemaps": f"select {_HOST} host, url as address, count(*) n from page where not starts_with({_HOST}, 'm.') group by 1, 2",
    "sc10_feed": "with e as (select source, doc_id, strftime(date '2024-01-01' + (doc_id % 60)::int, '%Y-%m-%d') as day from doc) select source, doc_id, day from e where day between '2024-01-10' and '2024-01-31' and doc_id % 5 <> 0",
    "sc11_channel_pages": "select channel, count(*) posts, count_if(post_id % 13 = 5) invalid, max(post_id) last_post, case when count_if(post_id % 13 = 5) > 0 then 'partial' else 'success' end coverage from post group by 1",
}
