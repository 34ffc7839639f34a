"""Queries over facts, drafts and catalogue state: keyed writes, visibility, fences, lineage, reconciliation, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import prices
from quotemill.functions import text as t
from quotemill.functions import urls
from quotemill.operators import checks, history
from quotemill.plans import comparison
from quotemill.plans.history import QUOTE_ORDER
from quotemill.sources.views import chk, doc, obs, page, post, quote, rule

#: What to do about documents of a class, and its rank of significance (fixed values).
ACTIONS = {"en": "Check the price list", "de": "Ask the dealer", "fr": "Watch the series"}
RANKS = {"priced": 0, "on_request": 1, "no_price": 2, "not_found": 3}


def sc2_catalogue_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every product with its current document, in one scan."""
    return rule(spark, d).join(doc(spark, d).select(F.col("doc_id").alias("rule_id"), F.sha2("text", 256).alias("document")), "rule_id", "left").select("rule_id", "title", "document")


def sc6_references(spark: SparkSession, d: str) -> DataFrame:
    """Specifications of products: inline ones, else the document they refer to, else the product's own."""
    x, k = rule(spark, d), F.col("rule_id")
    x = x.select("rule_id", F.when(k % 3 == 0, F.concat("title", F.lit("; "), "category")).alias("inline"), F.when(k % 3 == 1, k + 1).alias("ref"))
    docs = doc(spark, d).select("doc_id", F.length("text").alias("chars"))
    x = x.join(docs.select(F.col("doc_id").alias("ref"), F.col("chars").alias("of_ref")), "ref", "left").join(docs.select(F.col("doc_id").alias("rule_id"), F.col("chars").alias("own")), "rule_id", "left")
    origin = F.when(F.col("inline").isNotNull(), "inline").when(F.col("of_ref").isNotNull(), "reference").when(F.col("own").isNotNull(), "current")
    return x.select("rule_id", origin.alias("origin"), F.coalesce(F.length("inline"), "of_ref", "own").cast("long").alias("chars"))


def sc5_documents(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents by the fingerprint of their canonical form, whatever the order of their keys, and which are references."""
    lang, source = F.col("lang"), F.col("source")
    ref = F.concat(F.lit('{"ref": "'), source, F.lit('"}'))
    written = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(source.alias("source"), lang.alias("lang")))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{ "lang": "'), lang, F.lit('",  "source": "'), source, F.lit('"}'))).otherwise(ref)
    v = F.parse_json(written)
    x = doc(spark, d).where("lang is not null and source is not null").select(F.sha2(F.to_json(v), 256).alias("fingerprint"), F.try_variant_get(v, "$.ref", "string").isNotNull().alias("is_ref"))
    return x.groupBy("fingerprint", "is_ref").agg(F.count("*").alias("n"))


def sc13_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Items of nested bundles, a bundle for each channel."""
    bundles = post(spark, d).groupBy("channel").agg(F.to_json(F.struct(F.collect_list(F.struct("post_id", F.length("text").alias("chars"))).alias("items"))).alias("json"))
    return bundles.select("channel", F.explode(F.from_json("json", "items array<struct<post_id: bigint, chars: bigint>>")["items"]).alias("x")).select("channel", "x.post_id", "x.chars")


def sc14_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Sheet rows (a category, its products, their attributes) folded into products: both headers carried forward."""
    r = rule(spark, d).select("rule_id", "manufacturer", "size")
    heads = r.select("manufacturer").distinct().select("manufacturer", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("part"), F.col("manufacturer").alias("category"), F.lit(None).cast("long").alias("product"))
    products = r.select("manufacturer", F.col("rule_id").alias("at"), F.lit(1).alias("part"), F.lit(None).cast("string").alias("category"), F.col("rule_id").alias("product"))
    details = r.select("manufacturer", F.col("rule_id").alias("at"), F.explode(F.sequence(F.lit(2), F.col("rule_id").cast("int") % 3 + 2)).alias("part"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("long").alias("product"))
    w = Window.partitionBy("manufacturer").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = heads.union(products).union(details).select("part", F.last("category", ignorenulls=True).over(w).alias("category"), F.last("product", ignorenulls=True).over(w).alias("product"))
    return filled.where("part > 1").groupBy("category", "product").agg(F.count("*").alias("attributes"))


def sk13_publish(spark: SparkSession, d: str) -> DataFrame:
    """Facts published by product and kind: a priced one is immutable, the first stays; of other kinds the last."""
    place = F.struct("checked_at", "obs_id")
    x = obs(spark, d).groupBy("rule_id", "status").agg(F.min_by("obs_id", place).alias("a"), F.max_by("obs_id", place).alias("b"))
    return x.select("rule_id", "status", F.when(F.col("status") == "priced", F.col("a")).otherwise(F.col("b")).alias("obs_id"))


def sk14_baselines(spark: SparkSession, d: str) -> DataFrame:
    """The baseline of each product and currency is replaced by each new price."""
    return obs(spark, d).where("price is not null").groupBy("rule_id", "currency").agg(F.max_by("price", F.struct("checked_at", "obs_id")).cast("double").alias("baseline"))


def sk16_audit_then_update(spark: SparkSession, d: str) -> DataFrame:
    """Labels validated anew: the old one is appended to the audit, then the current one is set where one was given."""
    x, k = doc(spark, d), F.col("doc_id")
    fresh = F.when(k % 4 == 0, F.lit(1)).when(k % 4 == 1, F.lit(0))
    return x.select("doc_id", F.coalesce(fresh, "quality").alias("quality"), F.when(k % 4 < 3, F.concat_ws("→", F.coalesce(F.col("quality").cast("string"), F.lit("?")), F.coalesce(fresh.cast("string"), F.lit("?")))).alias("audit"))


def sk17_partial_update(spark: SparkSession, d: str) -> DataFrame:
    """Only supplied fields change."""
    c = chk(spark, d)
    new = c.where("check_id % 2 = 0").select("check_id", F.when(F.col("check_id") % 4 == 0, "paused").alias("new_status"), F.when(F.col("check_id") % 4 == 2, F.concat("url", F.lit("/v2"))).alias("new_url"))
    return c.join(new, "check_id", "left").select("check_id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_url", "url").alias("url"))


def sk18_event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events of one product in one hour are one: the first is inserted, the others ignored and counted."""
    x = obs(spark, d).groupBy("rule_id", F.date_trunc("hour", "checked_at").alias("hour"))
    return x.agg(F.min_by("obs_id", F.struct("checked_at", "obs_id")).alias("obs_id"), (F.count("*") - 1).alias("ignored")).drop("hour")


def _visible(spark: SparkSession, d: str) -> DataFrame:
    """All products but those of one source, of which a scope row must confirm the brand for the current document."""
    r, k = rule(spark, d), F.col("rule_id")
    r = r.withColumn("hash", F.sha2(F.concat_ws("|", "title", F.col("size").cast("string")), 256)).withColumn("restricted", F.col("manufacturer").startswith("Brand#1"))
    scope = r.where("rule_id % 3 = 0").select("rule_id", F.when(k % 2 == 0, F.col("hash")).otherwise(F.sha2("hash", 256)).alias("hash"), F.lit(True).alias("confirmed"))
    return r.join(scope, ["rule_id", "hash"], "left").select("rule_id", (~F.col("restricted") | F.coalesce("confirmed", F.lit(False))).alias("visible"))


def fi1_visibility(spark: SparkSession, d: str) -> DataFrame:
    return _visible(spark, d)


def fi2_result_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Results of visible products, and diagnostic ones of any."""
    x = obs(spark, d).join(_visible(spark, d), "rule_id").where("visible or status in ('network_error', 'not_found')")
    return x.groupBy("status").agg(F.count("*").alias("n"), F.count_if(~F.col("visible")).alias("diagnostic_only"))


def fi13_unselected(spark: SparkSession, d: str) -> DataFrame:
    """Pages of brands that are not selected go, unless the address holds what is kept."""
    url = F.lower("url")
    return page(spark, d).where(~(url.contains("blog.") | url.contains("//m.")) | url.contains("example.com")).select("page_id")


def fi14_research_list(spark: SparkSession, d: str) -> DataFrame:
    """Items of a month or without one that no later item of their product and status supersedes."""
    w = Window.partitionBy("rule_id", "status").orderBy(F.desc("checked_at"), F.desc("obs_id"))
    x = obs(spark, d).withColumn("period", F.when(F.col("obs_id") % 6 != 0, F.date_format("checked_at", "yyyy-MM"))).withColumn("k", F.row_number().over(w))
    return x.where((F.col("k") == 1) & (F.col("period").isNull() | (F.col("period") == "2024-03"))).select("obs_id", "status", "period")


def fi15_significant(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a site that are shown: those that are no news, and news only where confirmed."""
    return doc(spark, d).where((F.col("lang") != "en") | F.coalesce(F.col("quality") == 1, F.lit(False))).groupBy("lang").agg(F.count("*").alias("n"))


def fi18_draft_items(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed documents of which every piece of evidence is a fingerprint that the registry holds."""
    x, k = doc(spark, d), F.col("doc_id")
    registry = x.where("doc_id % 7 <> 0").select(F.sha2("text", 256).alias("id")).distinct()
    ids = x.where("quality = 1").select("doc_id", F.explode(F.array(F.sha2("text", 256), F.when(k % 5 == 0, "no fingerprint").otherwise(F.sha2("text", 256)))).alias("id"))
    held = ids.join(registry.withColumn("there", F.lit(True)), "id", "left")
    return held.groupBy("doc_id").agg(F.bool_and(F.col("id").rlike("^[0-9a-f]{64}$") & F.coalesce("there", F.lit(False))).alias("ok")).where("ok").select("doc_id")


def fi20_failed(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).where("status in ('network_error', 'not_found')").orderBy("checked_at", "obs_id").limit(100).select("obs_id", "status")


def jo10_memory(spark: SparkSession, d: str) -> DataFrame:
    """New pages that the memory holds are cached, others pending; of equal addresses the first page writes."""
    p = page(spark, d).select("page_id", urls.canonical(F.col("url")).alias("address"))
    memory = p.where("page_id % 3 = 0").select("address").distinct().withColumn("known", F.lit(True))
    new = p.where("page_id % 3 <> 0").groupBy("address").agg(F.min("page_id").alias("page_id"))
    return new.join(memory, "address", "left").select("page_id", F.when(F.col("known"), "cached").otherwise("pending").alias("state"))


def jo15_bound_terms(spark: SparkSession, d: str) -> DataFrame:
    """The last price of each product with the terms recorded at that very check, never with another's."""
    q = quote(spark, d)
    last = history.latest(q.where("status = 'priced'"), ["rule_id"], QUOTE_ORDER, ["checked_at", "price"])
    terms = q.where("line_no = 1").groupBy("rule_id", "checked_at").agg(F.min(F.struct("basis", "rate")).alias("t"))
    return last.join(terms, ["rule_id", "checked_at"], "left").select("rule_id", F.col("price").cast("double").alias("price"), "t.basis", "t.rate")


def jo23_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of documents under keys that begin with their manifest's: declared and found."""
    x = doc(spark, d).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("manifest"), F.greatest(F.lit(1), F.ceil(F.length("text") / 1000)).alias("declared"))
    parts = x.select(F.concat("manifest", F.lit(":")).alias("p"), F.explode(F.sequence(F.lit(1).cast("long"), "declared")).alias("i")).where("i % 5 <> 0").select(F.concat("p", F.col("i").cast("string")).alias("key"))
    found = parts.groupBy(F.substring_index("key", ":", 2).alias("manifest")).agg(F.count("*").alias("found"))
    return x.join(found, "manifest", "left").select("manifest", "declared", F.coalesce("found", F.lit(0)).alias("found"))


def jo24_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Cards that moved: one old and one new card of the same brand, title and size, where the old one's last check found no page."""
    key, r = ["manufacturer", "title", "size"], rule(spark, d)
    half = [r.where(f"rule_id % 2 = {i}").groupBy(*key).agg(F.min("rule_id").alias(n), F.count("*").alias(f"n_{n}")).where(f"n_{n} = 1").drop(f"n_{n}") for i, n in enumerate(("old", "new"))]
    last = obs(spark, d).groupBy(F.col("rule_id").alias("old")).agg(F.max_by("status", F.struct("checked_at", "obs_id")).alias("last_status"))
    return half[0].join(half[1], key).join(last, "old", "left").select("old", "new", F.coalesce(F.col("last_status").isin("not_found", "network_error"), F.lit(False)).alias("accepted"))


def jo25_current_review(spark: SparkSession, d: str) -> DataFrame:
    """The last confirmed review of each product, if it was made for the current fingerprint (the last rate)."""
    q = quote(spark, d)
    now = history.latest(q, ["rule_id"], QUOTE_ORDER, ["rate"]).select("rule_id", F.col("rate").alias("fingerprint"))
    reviews = q.where("status = 'priced'").join(now, "rule_id").where("rate = fingerprint")
    return reviews.groupBy("rule_id", "fingerprint").agg(F.max("checked_at").cast("date").cast("string").alias("reviewed"), F.count("*").alias("reviews"))


def jo26_fence(spark: SparkSession, d: str) -> DataFrame:
    """Drafts by source: released only where no expected version differs from the current one."""
    x = doc(spark, d).select("source", "doc_id", F.sha2("text", 256).alias("current"))
    expected = x.select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.lit("old")).otherwise(F.col("current")).alias("expected"))
    return x.join(expected, "doc_id").groupBy("source").agg(F.count_if(F.col("current") != F.col("expected")).alias("stale")).select("source", "stale", (F.col("stale") == 0).alias("released"))


def jo28_channel_owners(spark: SparkSession, d: str) -> DataFrame:
    """Channels by handle to their competitor; those that nobody owns go to the first one."""
    owners = chk(spark, d).where("kind = 'telegram'").groupBy(F.col("check_id").alias("channel")).agg(F.min("competitor").alias("competitor"))
    first = chk(spark, d).agg(F.min("competitor")).first()[0]
    x = post(spark, d).groupBy("channel").agg(F.count("*").alias("posts")).join(owners, "channel", "left")
    return x.groupBy(F.coalesce("competitor", F.lit(first)).alias("competitor")).agg(F.count("*").alias("channels"), F.sum("posts").alias("posts"))


def ag11_selected_kinds(spark: SparkSession, d: str) -> DataFrame:
    """By competitor: selected checks of each kind; incomplete with any partial or error, or with fewer than two kinds."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("news", "products", "telegram")]
    x = chk(spark, d).groupBy("competitor").agg(*kinds, F.bool_or(F.col("status") != "success").alias("bad"), F.count_distinct("kind").alias("n"))
    return x.select("competitor", "news", "products", "telegram", (F.col("bad") | (F.col("n") < 2)).alias("incomplete"))


def ag20_legacy_audit(spark: SparkSession, d: str) -> DataFrame:
    """Legacy documents by what an audit says of them, the first reason that applies."""
    status = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty").when(F.col("quality").isNull(), "unconfirmed").when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "toxic").when(F.length("text") < 200, "too_short").otherwise("verified")
    return doc(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def ag21_complete_variants(spark: SparkSession, d: str) -> DataFrame:
    """Runs of which every line was read and has a price."""
    return quote(spark, d).groupBy("run_id").agg(F.bool_and((F.col("status") != "no_price") & F.col("price").isNotNull()).alias("complete"), F.count("*").alias("variants"))


def wi11_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals numbered as revisions of their product's draft."""
    return obs(spark, d).select("obs_id", F.row_number().over(Window.partitionBy("rule_id").orderBy("checked_at", "obs_id")).cast("long").alias("revision"))


def li8_section_order(spark: SparkSession, d: str) -> DataFrame:
    """By host its pages in the order in which sections are read: plain ones, paged ones, those of trackers."""
    x = urls.identity(F.col("url"))
    rank = F.when(x["query"] == "", 0).when(x["query"].contains("page="), 1).otherwise(2)
    p = page(spark, d).select("page_id", x["host"].alias("host"), rank.alias("rank"), "url")
    return p.select("page_id", F.row_number().over(Window.partitionBy("host").orderBy("rank", "url", "page_id")).cast("long").alias("place"))


def li9_significance(spark: SparkSession, d: str) -> DataFrame:
    """The fifty most significant checks: by rank of their status, then the newest."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in RANKS.items() for v in p]), F.col("status")), F.lit(9))
    return obs(spark, d).orderBy(rank, F.desc("checked_at"), F.desc("obs_id")).limit(50).select("obs_id", "status")


def se1_union(spark: SparkSession, d: str) -> DataFrame:
    """Official and research events in one table; an id in both is an error."""
    official = doc(spark, d).where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("official").alias("origin"))
    research = doc(spark, d).where("doc_id % 10 = 0").select(F.when(F.col("doc_id") % 20 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 10_000_000).alias("id"), F.lit("research").alias("origin"))
    both = official.unionByName(research).groupBy("id").agg(F.count("*").alias("n"), F.min("origin").alias("origin"))
    return both.select("id", "origin", F.when(F.col("n") > 1, "id collision").alias("error"))


def st5_scope_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The next batch of products whose scope is not known for their current hash, a hundred at a time."""
    r = rule(spark, d).select("rule_id", F.sha2("title", 256).alias("hash"))
    done = r.where("rule_id % 3 = 0").select("rule_id", F.when(F.col("rule_id") % 6 == 0, F.col("hash")).otherwise(F.lit("old")).alias("hash"))
    return r.join(done, ["rule_id", "hash"], "left_anti").orderBy("rule_id").limit(100).select("rule_id")


def st6_replay(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that were handed over twice after a lost acknowledgement are applied once."""
    x = obs(spark, d).withColumn("payload", F.date_format("checked_at", "yyyy-MM-dd"))
    again = x.where(F.dayofmonth("checked_at") % 3 == 0)
    return x.unionByName(again).dropDuplicates(["payload", "obs_id"]).groupBy("payload").agg(F.count("*").alias("applied"))


def st7_event_projection(spark: SparkSession, d: str) -> DataFrame:
    """A stream of extracted articles folded: versions of each event, its current one, and whether it was superseded."""
    x = obs(spark, d).select("rule_id", "obs_id", "checked_at", F.sha2(F.concat_ws("|", "status", "currency"), 256).alias("version"))
    log = x.groupBy("rule_id", "version").agg(F.min(F.struct("checked_at", "obs_id")).alias("first"))
    return log.groupBy("rule_id").agg(F.count("*").alias("versions"), F.max("first")["obs_id"].alias("current_id"))


def co3_group_prices(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth product against all of other brands with its title and size: difference of their last gross quotes."""
    r = rule(spark, d).select("rule_id", "manufacturer", "title", "size")
    q = comparison._quotes(spark, d, "gross")
    own = r.where("rule_id % 100 = 0").join(q, "rule_id", "left").select(F.col("rule_id").alias("anchor"), F.col("manufacturer").alias("brand"), "title", "size", F.col("gross").alias("own"))
    other = r.join(q, "rule_id", "left").select(F.col("rule_id").alias("chosen"), "manufacturer", "title", "size", F.col("gross").alias("other"))
    pairs = own.join(other, ["title", "size"]).where("brand <> manufacturer")
    return pairs.select("anchor", "chosen", prices.delta("own", "other").alias("x")).select("anchor", "chosen", "x.delta", "x.gap", "x.note")


def co5_brand_overview(spark: SparkSession, d: str) -> DataFrame:
    """By brand: models with prices, those whose price changed, up and down."""
    s = comparison._statistics(spark, d)
    return s.groupBy("manufacturer").agg(F.count_distinct("rule_id").alias("models"), F.count("change").alias("with_change"), F.count_if(F.col("change") > 0).alias("up"), F.count_if(F.col("change") < 0).alias("down"))


def co8_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Brands against their crawl: only a complete manifest (no network error on a brand's last checks) tells of absent products."""
    r = rule(spark, d).select("rule_id", "manufacturer")
    last = obs(spark, d).groupBy("rule_id").agg(F.max_by("status", F.struct("checked_at", "obs_id")).alias("last_status"))
    x = r.join(last, "rule_id", "left").groupBy("manufacturer").agg(F.count_if(F.col("last_status") == "network_error").alias("incomplete"), F.count("last_status").alias("seen"), F.count_if(F.col("last_status").isNull()).alias("absent"), F.count_if(F.col("last_status") == "not_found").alias("gone"))
    complete = (F.col("incomplete") == 0) & (F.col("seen") > 0)
    return x.select("manufacturer", complete.alias("complete"), F.when(complete, F.col("absent") + F.col("gone")).otherwise(0).alias("to_review"))


def co9_projection(spark: SparkSession, d: str) -> DataFrame:
    """Verified documents of each source and language, the first of equal texts, with the share of the source."""
    first = doc(spark, d).where("quality = 1").groupBy(F.sha2(F.lower(t.squeezed(F.col("text"))), 256).alias("key")).agg(F.min_by(F.struct("source", "lang"), "doc_id").alias("x"))
    n = first.groupBy(F.col("x.source").alias("source"), F.col("x.lang").alias("lang")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4))


def co10_management(spark: SparkSession, d: str) -> DataFrame:
    """By source: signals, risks, quality and the most frequent action."""
    action = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in ACTIONS.items() for v in p]), F.col("lang")), F.lit("Note it"))
    x = doc(spark, d).withColumn("action", action)
    n = x.groupBy("source", "action").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("signals"), F.count_if(F.col("toxic") == 1).alias("risks"))
    return n.groupBy("source").agg(F.sum("signals").alias("signals"), F.sum("risks").alias("risks"), F.max_by("action", F.struct("n", "action")).alias("action"))


def fn61_actions(spark: SparkSession, d: str) -> DataFrame:
    """What to do about a document, by its language and words of its beginning."""
    low = F.lower(F.left("text", F.lit(200)))
    action = F.when(low.contains("price") | low.contains("tion"), "Compare prices").when(F.col("lang") == "de", ACTIONS["de"]).when(F.col("lang") == "fr", ACTIONS["fr"]).otherwise("Note it")
    return doc(spark, d).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def co13_release(spark: SparkSession, d: str) -> DataFrame:
    """Drafts by source: items that are missing, unconfirmed or changed, and whether the draft may go out."""
    facts = doc(spark, d).select("doc_id", "quality", F.sha2("text", 256).alias("version"))
    draft = doc(spark, d).where("doc_id % 3 = 0").select("source", (F.col("doc_id") + F.when(F.col("doc_id") % 60 == 0, 10_000_000).otherwise(0)).alias("doc_id"), F.sha2(F.when(F.col("doc_id") % 90 == 9, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("seen"))
    j = draft.join(facts, "doc_id", "left")
    x = j.groupBy("source").agg(F.count_if(F.col("version").isNull()).alias("missing"), F.count_if(F.col("version").isNotNull() & (F.coalesce("quality", F.lit(0)) != 1)).alias("unconfirmed"), F.count_if((F.col("quality") == 1) & (F.col("version") != F.col("seen"))).alias("changed"))
    return x.withColumn("released", F.col("missing") + F.col("unconfirmed") + F.col("changed") == 0)


def co15_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on pages by their errors: unit, order of the corners, bounds of the page, a second box of a product and line."""
    q = quote(spark, d)
    w = Window.partitionBy("rule_id", "line_no").orderBy("run_id", "source_id", "checked_at", "price")
    x = q.select("rate", "source_id", F.col("line_no").alias("x0"), (F.col("line_no") + F.col("rate") - 2).alias("x1"), F.row_number().over(w).alias("k"))
    errors = F.array_compact(F.array(F.when(F.col("source_id") % 10 == 0, "unit"), F.when(F.col("x1") <= F.col("x0"), "box"), F.when(F.col("x1") > 10, "bounds"), F.when(F.col("k") > 1, "second")))
    return x.groupBy(F.array_join(errors, ",").alias("errors")).agg(F.count("*").alias("n"))


def co19_price_guard(spark: SparkSession, d: str) -> DataFrame:
    """A saved own price counts only where the saved model resolves to the matched product alone."""
    r = rule(spark, d)
    saved = r.where("rule_id % 2 = 0").select(F.concat_ws(" ", "manufacturer", "title", F.col("size").cast("string")).alias("model"), F.col("rule_id").alias("matched"), "list_price")
    known = r.groupBy(F.concat_ws(" ", "manufacturer", "title", F.col("size").cast("string")).alias("model")).agg(F.count("*").alias("n"), F.min("rule_id").alias("only"))
    ok = (F.col("n") == 1) & (F.col("only") == F.col("matched"))
    return saved.join(known, "model").select("matched", F.when(ok, F.col("list_price")).cast("double").alias("price"))


def co20_change_set(spark: SparkSession, d: str) -> DataFrame:
    """Editorial changes: of allowed fields only, one for an item, made against the current version; others give an error."""
    x, k = doc(spark, d), F.col("doc_id")
    changes = x.where("doc_id % 4 = 0").select("doc_id", F.when(k % 12 == 0, "quality").otherwise("title").alias("field"), F.when(k % 20 == 0, "old").otherwise(F.sha2("text", 256)).alias("version"))
    changes = changes.unionAll(changes.where("doc_id % 28 = 0"))
    n = changes.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("field").alias("field"), F.min("version").alias("version"))
    j = n.join(x.select("doc_id", F.sha2("text", 256).alias("current")), "doc_id")
    error = F.when(F.col("field") != "title", "field").when(F.col("n") > 1, "several").when(F.col("version") != F.col("current"), "version")
    return j.groupBy(F.coalesce(error, F.lit("applied")).alias("outcome")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (sc2_catalogue_scan, sc6_references, sc5_documents, sc13_bundles, sc14_hierarchy, sk13_publish, sk14_baselines, sk16_audit_then_update, sk17_partial_update, sk18_event_log, fi1_visibility, fi2_result_visibility, fi13_unselected, fi14_research_list, fi15_significant, fi18_draft_items, fi20_failed, jo10_memory, jo15_bound_terms, jo23_parts, jo24_lineage, jo25_current_review, jo26_fence, jo28_channel_owners, ag11_selected_kinds, ag20_legacy_audit, ag21_complete_variants, wi11_revisions, li8_section_order, li9_significance, se1_union, st5_scope_backfill, st6_replay, st7_event_projection, co3_group_prices, co5_brand_overview, co8_reconcile, co9_projection, co10_management, fn61_actions, co13_release, co15_geometry, co19_price_guard, co20_change_set)}

_LASTQ = "(select rule_id, max((checked_at, run_id, line_no, source_id, price, basis, rate)) m from quote where status = 'priced' group by 1)"
_LASTOBS = "(select rule_id, arg_max(status, (checked_at, obs_id)) s from obs group by 1)"
_VISIBLE = "v as (select rule_id, not starts_with(manufacturer, 'Brand#1') or rule_id % 6 = 0 visible from rule)"
_ADDRESS = "(select page_id, lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^([A-Za-z]+://[^/]*)', 1)) || coalesce(nullif(regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[A-Za-z]+://[^/]*', ''), '/+$', ''), ''), '/') || '?' || coalesce(array_to_string(list_sort(list_filter(string_split(regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)='))), '&'), '') as address from page)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
_ACTION = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in ACTIONS.items()) + " else 'Note it' end"
_STATS = comparison.STATS
SQL = {
    "sc2_catalogue_scan": "select rule_id, title, sha256(d.text) document from rule left join documents d on d.doc_id = rule_id",
    "sc6_references": "select r.rule_id, case when r.rule_id % 3 = 0 then 'inline' when b.doc_id is not null then 'reference' when c.doc_id is not null then 'current' end origin, case when r.rule_id % 3 = 0 then length(title || '; ' || category) else coalesce(length(b.text), length(c.text)) end chars from rule r left join documents b on r.rule_id % 3 = 1 and b.doc_id = r.rule_id + 1 left join documents c on c.doc_id = r.rule_id",
    "sc5_documents": """select sha256(case when doc_id % 3 < 2 then '{"lang":"' || lang || '","source":"' || source || '"}' else '{"ref":"' || source || '"}' end) fingerprint, doc_id % 3 = 2 is_ref, count(*) n from doc where lang is not null and source is not null group by 1, 2""",
    "sc13_bundles": "select channel, post_id, length(text) chars from post",
    "sc14_hierarchy": "select manufacturer category, rule_id product, rule_id % 3 + 1 attributes from rule",
    "sk13_publish": "select rule_id, status, case when status = 'priced' then arg_min(obs_id, (checked_at, obs_id)) else arg_max(obs_id, (checked_at, obs_id)) end obs_id from obs group by 1, 2",
    "sk14_baselines": "select rule_id, currency, arg_max(price, (checked_at, obs_id))::double baseline from obs where price is not null group by 1, 2",
    "sk16_audit_then_update": "select doc_id, coalesce(f, quality) quality, case when doc_id % 4 < 3 then coalesce(quality::varchar, '?') || '→' || coalesce(f::varchar, '?') end audit from (select *, case doc_id % 4 when 0 then 1 when 1 then 0 end f from doc)",
    "sk17_partial_update": "select check_id, case when check_id % 4 = 0 then 'paused' else status end status, case when check_id % 4 = 2 then url || '/v2' else url end url from chk",
    "sk18_event_log": "select rule_id, arg_min(obs_id, (checked_at, obs_id)) obs_id, count(*) - 1 ignored from obs group by rule_id, date_trunc('hour', checked_at)",
    "fi1_visibility": f"with {_VISIBLE} select * from v",
    "fi2_result_visibility": f"with {_VISIBLE} select status, count(*) n, count_if(not visible) diagnostic_only from obs join v using (rule_id) where visible or status in ('network_error', 'not_found') group by 1",
    "fi13_unselected": "select page_id from page where not (lower(url) like '%blog.%' or lower(url) like '%//m.%') or lower(url) like '%example.com%'",
    "fi14_research_list": "with x as (select *, case when obs_id % 6 <> 0 then strftime(checked_at, '%Y-%m') end period, row_number() over (partition by rule_id, status order by checked_at desc, obs_id desc) k from obs) select obs_id, status, period from x where k = 1 and (period is null or period = '2024-03')",
    "fi15_significant": "select lang, count(*) n from doc where lang <> 'en' or coalesce(quality = 1, false) group by 1",
    "fi18_draft_items": "select doc_id from doc where quality = 1 and doc_id % 5 <> 0 and text in (select text from doc where doc_id % 7 <> 0)",
    "fi20_failed": "select obs_id, status from obs where status in ('network_error', 'not_found') order by checked_at, obs_id limit 100",
    "jo10_memory": f"with p as (select * from {_ADDRESS}), n as (select address, min(page_id) page_id from p where page_id % 3 <> 0 group by 1) select page_id, case when address in (select address from p where page_id % 3 = 0) then 'cached' else 'pending' end state from n",
    "jo15_bound_terms": f"with b as (select rule_id, checked_at, min((basis, rate)) t from quote where line_no = 1 group by 1, 2), l as {_LASTQ} select l.rule_id, l.m[5]::double price, t[1] basis, t[2] rate from l left join b on b.rule_id = l.rule_id and b.checked_at = l.m[1]",
    "jo23_parts": "select 'doc:' || doc_id manifest, greatest(1, ceil(length(text) / 1000))::bigint declared, declared - declared // 5 found from doc",
    "jo24_lineage": f"with o as (select manufacturer, title, size, min(rule_id) old from rule where rule_id % 2 = 0 group by 1, 2, 3 having count(*) = 1), n as (select manufacturer, title, size, min(rule_id) new from rule where rule_id % 2 = 1 group by 1, 2, 3 having count(*) = 1), l as {_LASTOBS} select old, new, coalesce(s in ('not_found', 'network_error'), false) accepted from o join n using (manufacturer, title, size) left join l on l.rule_id = old",
    "jo25_current_review": "with l as (select rule_id, max((checked_at, run_id, line_no, source_id, price, basis, rate)) m from quote group by 1) select q.rule_id, q.rate fingerprint, max(checked_at)::date::varchar reviewed, count(*) reviews from quote q join l on l.rule_id = q.rule_id and q.rate = l.m[7] where status = 'priced' group by 1, 2",
    "jo26_fence": "select source, count_if(doc_id % 50 = 0) stale, count_if(doc_id % 50 = 0) = 0 released from doc group by 1",
    "jo28_channel_owners": "with o as (select check_id channel, min(competitor) c from chk where kind = 'telegram' group by 1), p as (select channel, count(*) n from post group by 1) select coalesce(c, (select min(competitor) from chk)) competitor, count(*) channels, sum(n)::bigint posts from p left join o using (channel) group by 1",
    "ag11_selected_kinds": "select competitor, count_if(kind = 'news') news, count_if(kind = 'products') products, count_if(kind = 'telegram') telegram, bool_or(status <> 'success') or count(distinct kind) < 2 incomplete from chk group by 1",
    "ag20_legacy_audit": "select case when coalesce(length(text), 0) = 0 then 'empty' when quality is null then 'unconfirmed' when quality = 0 then 'rejected' when toxic = 1 then 'toxic' when length(text) < 200 then 'too_short' else 'verified' end status, count(*) n from doc group by 1",
    "ag21_complete_variants": "select run_id, bool_and(status <> 'no_price' and price is not null) complete, count(*) variants from quote group by 1",
    "wi11_revisions": "select obs_id, row_number() over (partition by rule_id order by checked_at, obs_id) revision from obs",
    "li8_section_order": rf"select page_id, row_number() over (partition by {_HOST} order by case when regexp_extract(url, '\?([^#]*)', 1) = '' then 0 when regexp_extract(url, '\?([^#]*)', 1) like '%page=%' then 1 else 2 end, url, page_id) place from page",
    "li9_significance": "select obs_id, status from obs order by case status when 'priced' then 0 when 'on_request' then 1 when 'no_price' then 2 when 'not_found' then 3 else 9 end, checked_at desc, obs_id desc limit 50",
    "se1_union": "with u as (select doc_id id, 'official' origin from doc where quality = 1 union all select case when doc_id % 20 = 0 then doc_id else doc_id + 10000000 end, 'research' from doc where doc_id % 10 = 0) select id, min(origin) origin, case when count(*) > 1 then 'id collision' end error from u group by 1",
    "st5_scope_backfill": "select rule_id from rule where rule_id % 6 <> 0 order by rule_id limit 100",
    "st6_replay": "select strftime(checked_at, '%Y-%m-%d') payload, count(*) applied from obs group by 1",
    "st7_event_projection": "with v as (select rule_id, status || '|' || currency v, min((checked_at, obs_id)) f from obs group by 1, 2) select rule_id, count(*) versions, max(f)[2] current_id from v group by 1",
    "co3_group_prices": f"with g as {comparison._last('gross')}, r as (select rule_id, manufacturer, title, size, m[5]::double p, case when rule_id % 9 = 0 then 'USD' else 'RUB' end cur, rule_id % 4 <> 0 piece from rule left join g using (rule_id)), j as (select a.rule_id anchor, b.rule_id chosen, a.p x, b.p y, case when a.p is null or b.p is null then 'no price' when a.cur <> b.cur then 'currency' end stop, a.piece and b.piece known from r a join r b using (title, size) where a.rule_id % 100 = 0 and a.manufacturer <> b.manufacturer) select anchor, chosen, case when stop is null then round(y - x, 2) end delta, case when stop is null and x <> 0 then round((y - x) / x * 100, 4) end gap, case when stop is not null then stop when not known then 'unit unknown' else '' end note from j",
    "co5_brand_overview": f"with m as (select *, case when points > 1 and a <> 0 then (b - a) / a * 100 end change from ({_STATS}) join rule using (rule_id)) select manufacturer, count(distinct rule_id) models, count(change) with_change, count_if(change > 0) up, count_if(change < 0) down from m group by 1",
    "co8_reconcile": f"with l as {_LASTOBS}, x as (select manufacturer, count_if(s = 'network_error') incomplete, count(s) seen, count_if(s is null) absent, count_if(s = 'not_found') gone from rule left join l using (rule_id) group by 1) select manufacturer, incomplete = 0 and seen > 0 complete, case when incomplete = 0 and seen > 0 then absent + gone else 0 end to_review from x",
    "co9_projection": r"with f as (select arg_min((source, lang), doc_id) x from doc where quality = 1 group by sha256(lower(trim(regexp_replace(text, '[\s\x0b\x85\p{Z}]+', ' ', 'g'))))), n as (select x[1] as source, x[2] lang, count(*) n from f group by 1, 2) select *, round(n / sum(n) over (partition by source), 4) as share from n",
    "co10_management": f"with n as (select source, {_ACTION} act, count(*) n, count_if(quality = 1) s, count_if(toxic = 1) r from doc group by 1, 2) select source, sum(s)::bigint signals, sum(r)::bigint risks, arg_max(act, (n, act)) as action from n group by 1",
    "fn61_actions": "select case when contains(lower(left(text, 200)), 'price') or contains(lower(left(text, 200)), 'tion') then 'Compare prices' when lang = 'de' then 'Ask the dealer' when lang = 'fr' then 'Watch the series' else 'Note it' end as action, count(*) n from doc group by 1",
    "co13_release": "with x as (select source, count_if(doc_id % 60 = 0) missing, count_if(doc_id % 60 <> 0 and coalesce(quality, 0) <> 1) unconfirmed, count_if(doc_id % 60 <> 0 and quality = 1 and doc_id % 90 = 9) changed from doc where doc_id % 3 = 0 group by 1) select *, missing + unconfirmed + changed = 0 released from x",
    "co15_geometry": "with x as (select *, line_no + rate - 2 x1, row_number() over (partition by rule_id, line_no order by run_id, source_id, checked_at, price) k from quote) select concat_ws(',', case when source_id % 10 = 0 then 'unit' end, case when x1 <= line_no then 'box' end, case when x1 > 10 then 'bounds' end, case when k > 1 then 'second' end) errors, count(*) n from x group by 1",
    "co19_price_guard": "with k as (select manufacturer, title, size, count(*) n from rule group by 1, 2, 3) select rule_id matched, case when n = 1 then list_price::double end price from rule join k using (manufacturer, title, size) where rule_id % 2 = 0",
    "co20_change_set": "select case when doc_id % 12 = 0 then 'field' when doc_id % 28 = 0 then 'several' when doc_id % 20 = 0 then 'version' else 'applied' end outcome, count(*) n from doc where doc_id % 4 = 0 group by 1",
}
