"""Queries over publications and channel posts: filters, classes, duplicates, versions, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import text as t
from quotemill.session import table
from quotemill.sources.views import doc, post

#: Keyword classes of the test corpus: words that its documents hold (fixed values).
CLASSES = {"technology": ("the ", "tion"), "finance": ("der ", "ung"), "events": ("que", "eau"), "people": ("ción", "los ")}


def fi5_publications(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed publications of two sources that hold a word in any case."""
    return doc(spark, d).where((F.col("quality") == 1) & F.col("source").isin("src1", "src2") & F.lower("text").contains("with")).select("doc_id", "source")


def wi4_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each squeezed, lower-cased beginning."""
    key = F.sha2(F.lower(t.squeezed(F.col("text"))), 256)
    return doc(spark, d).select("doc_id", key.alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def wi5_best_row(spark: SparkSession, d: str) -> DataFrame:
    """The best document of each source: quality, then length, then id."""
    return doc(spark, d).groupBy("source").agg(F.max_by("doc_id", F.struct(F.coalesce("quality", F.lit(-1)), "n_chars", "doc_id")).alias("doc_id"))


def wi9_diverse_top(spark: SparkSession, d: str, most: int = 30, posts: int = 3) -> DataFrame:
    """The longest documents, at most so many: of posts (here: German ones) three at most; the other places go to one
    document of each source first, then to the longest of the rest."""
    post_ = F.coalesce(F.col("lang") == "de", F.lit(False))
    x = doc(spark, d).select("doc_id", "source", "n_chars", post_.alias("post"))
    order = [F.desc("n_chars"), F.asc("doc_id")]
    chosen = x.where("post").orderBy(*order).limit(posts)
    site = x.where("not post").drop("post")
    first = site.groupBy("source").agg(F.min_by(F.struct("doc_id", "n_chars"), F.struct(-F.col("n_chars"), "doc_id")).alias("f")).select("f.doc_id", "source", "f.n_chars")
    rest = site.join(first.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "n_chars")
    both = first.orderBy(*order).limit(most).withColumn("late", F.lit(0)).union(rest.orderBy(*order).limit(most).withColumn("late", F.lit(1)))
    both = both.withColumn("place", F.row_number().over(Window.orderBy("late", *order))).withColumn("k", F.lit(1))  # 60 rows at most
    taken = chosen.agg(F.count("*").alias("taken")).withColumn("k", F.lit(1))
    site = both.join(F.broadcast(taken), "k").where(F.col("place") <= most - F.col("taken"))
    return site.select("doc_id", "source", F.lit("site").alias("kind")).union(chosen.select("doc_id", "source", F.lit("post")))


def fn57_classify(spark: SparkSession, d: str) -> DataFrame:
    c = t.keyword_class(F.col("text"), CLASSES, "other")
    return doc(spark, d).select("doc_id", c.alias("c")).select("doc_id", "c.category", F.col("c.hits").cast("long").alias("hits"), "c.confidence")


def fn8_brief(spark: SparkSession, d: str) -> DataFrame:
    """The first two sentences of posts, at most 420 characters."""
    return post(spark, d).select("channel", "post_id", t.first_sentences(F.col("text"), 2, 420).alias("brief"))


def ag13_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    q = doc(spark, d)
    return q.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("verified"), F.count_if(F.col("quality").isNull()).alias("unconfirmed"), F.count_if(F.col("quality") == 0).alias("rejected"))


def ag19_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: verified documents, the source that has most and how many, the three most frequent languages, and how many
    documents are unconfirmed or excluded."""
    n = doc(spark, d).groupBy("source", "lang", "quality").agg(F.count("*").alias("n"))
    verified = n.where("quality = 1")
    source = verified.groupBy("source").agg(F.sum("n").alias("n")).agg(F.min_by(F.struct("source", "n"), F.struct(-F.col("n"), "source")).alias("s"))
    top = verified.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(3).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "lang"))).alias("t"))
    names = F.array_join(F.transform("t", lambda x: F.concat(x["lang"], F.lit(" "), (-x["less"]).cast("string"))), ", ")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    out = n.agg(total(F.col("quality") == 1).alias("verified"), total(F.col("quality").isNull()).alias("unconfirmed"), total(F.col("quality") == 0).alias("excluded"))
    one = F.lit(1).alias("k")
    out = out.select("*", one).join(F.broadcast(source.select("s", one)), "k").join(F.broadcast(top.select(names.alias("categories"), one)), "k")
    return out.select("verified", "unconfirmed", "excluded", F.col("s.source").alias("most_active"), F.col("s.n").alias("most_active_n"), "categories")


def ag15_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Publications of every source of the corpus in English, zero where there are none."""
    every = doc(spark, d).select("source").distinct()
    return every.join(doc(spark, d).where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def jo18_drift(spark: SparkSession, d: str) -> DataFrame:
    """Draft items against the facts: gone, unconfirmed or changed."""
    facts = doc(spark, d).select("doc_id", "quality", F.sha2("text", 256).alias("version"))
    draft = table(spark, d, "documents").where("doc_id % 3 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 60 == 0, 10_000_000).otherwise(0)).alias("doc_id"), F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("seen"))
    j = draft.join(facts, "doc_id", "left")
    issue = F.when(F.col("version").isNull(), "missing").when(F.coalesce(F.col("quality") != 1, F.lit(True)), "unconfirmed").when(F.col("version") != F.col("seen"), "changed")
    return j.select("doc_id", issue.alias("issue")).where(F.col("issue").isNotNull())


def jo19_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Drafted documents with confirmed ones added."""
    x = doc(spark, d)
    drafted = x.where("doc_id % 4 = 0").select("doc_id", F.lit("draft").alias("origin"))
    return drafted.unionByName(x.where("quality = 1").join(drafted, "doc_id", "left_anti").select("doc_id", F.lit("added").alias("origin")))


def jo27_latest_audit(spark: SparkSession, d: str) -> DataFrame:
    """The last post of each channel and role."""
    return post(spark, d).groupBy("channel", "role").agg(F.max_by(F.length("text"), "post_id").cast("long").alias("chars"), F.max("post_id").alias("post_id"))


def sk8_field_policies(spark: SparkSession, d: str) -> DataFrame:
    """By channel: the newest text that isn't empty, the first role seen."""
    return post(spark, d).groupBy("channel").agg(F.max_by(F.nullif("text", F.lit("")), F.when(F.col("text") != "", F.col("post_id"))).alias("text"), F.min_by("role", "post_id").alias("role"))


def fn9_heading_split(spark: SparkSession, d: str) -> DataFrame:
    """First line as heading where it is short, else no heading."""
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    short = F.length(line) <= 80
    return post(spark, d).select("channel", "post_id", F.when(short, line).otherwise("").alias("heading"), F.when(short, "first_line").otherwise("none").alias("basis"))


def fn60_protected(spark: SparkSession, d: str) -> DataFrame:
    """How many numbers and codes each document must keep in translation."""
    return doc(spark, d).select("doc_id", F.size(t.protected_tokens(F.col("text"))).cast("long").alias("n"))


def sk3_content_store(spark: SparkSession, d: str) -> DataFrame:
    """Contents that are not in the store of the even documents yet, once each."""
    x = doc(spark, d).select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return x.where("doc_id % 2 = 1").join(x.where("doc_id % 2 = 0").select("fingerprint"), "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))


def fn43_content_id(spark: SparkSession, d: str) -> DataFrame:
    """Content ids of structured rows: equal content, equal id."""
    x = doc(spark, d).select("doc_id", F.sha2(F.concat_ws("\n", "source", "lang", F.col("n_chars").cast("string")), 256).alias("content_id"))
    return x.groupBy("content_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def sc12_reassembly(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into parts of 500 characters, put together again in order, complete and unchanged."""
    x = doc(spark, d).where("n_chars > 0")
    parts = x.select("doc_id", F.sha2("text", 256).alias("sha"), F.ceil(F.length("text") / 500).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / 500).cast("int")), lambda i: F.substr(F.col("text"), i * 500 + 1, F.lit(500)))).alias("at", "part"))
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "").alias("text"), F.count("*").alias("parts"), F.first("n").alias("n"), F.first("sha").alias("sha"))
    return whole.select("doc_id", "parts", ((F.col("parts") == F.col("n")) & (F.sha2("text", 256) == F.col("sha"))).alias("sound"))


QUERIES = {f.__name__: f for f in (fi5_publications, wi4_first_of_key, wi5_best_row, wi9_diverse_top, fn57_classify, fn8_brief, ag13_quality_summary, ag19_summary, ag15_by_source, jo18_drift, jo19_refresh, jo27_latest_audit, sk8_field_policies, fn9_heading_split, fn60_protected, sk3_content_store, fn43_content_id, sc12_reassembly)}
HITS = {k: " + ".join(f"contains(lower(text), '{w}')::int" for w in v) for k, v in CLASSES.items()}
SQUEEZE = r"trim(regexp_replace(text, '[\s\x0b\x85\p{Z}]+', ' ', 'g'))"
SQL = {
    "fi5_publications": "select doc_id, source from doc where quality = 1 and source in ('src1', 'src2') and contains(lower(text), 'with')",
    "wi4_first_of_key": f"select sha256(lower({SQUEEZE})) as key, min(doc_id) doc_id, count(*) copies from doc group by 1",
    "wi5_best_row": "select source, arg_max(doc_id, (coalesce(quality, -1), n_chars, doc_id)) doc_id from doc group by 1",
    "wi9_diverse_top": "with x as (select doc_id, source, n_chars, coalesce(lang = 'de', false) post from doc), p as (select * from x where post order by n_chars desc, doc_id limit 3), s as (select *, row_number() over (partition by source order by n_chars desc, doc_id) k from x where not post), t as (select *, row_number() over (order by (k > 1)::int, n_chars desc, doc_id) r from s) select doc_id, source, 'site' kind from t where r <= 30 - (select count(*) from p) union all select doc_id, source, 'post' from p",
    "fn57_classify": "with h as (select doc_id, " + ", ".join(f"{e} h{i}" for i, e in enumerate(HITS.values())) + " from doc), m as (select *, greatest(" + ", ".join(f"h{i}" for i in range(len(HITS))) + ") m from h) select doc_id, case when m = 0 then 'other' " + " ".join(f"when h{i} = m then '{k}'" for i, k in enumerate(HITS)) + " end category, m::bigint hits, case when m = 0 then 0.2::double else least(0.95, round(0.45 + 0.12 * m, 2))::double end confidence from m",
    "fn8_brief": f"select channel, post_id, case when length(s) > 420 then rtrim(left(s, 419)) || '…' else s end brief from (select channel, post_id, array_to_string(list_filter(string_split(regexp_replace({SQUEEZE}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> '')[1:2], ' ') s from post)",
    "ag13_quality_summary": "select lang, count_if(quality = 1) verified, count_if(quality is null) unconfirmed, count_if(quality = 0) rejected from doc group by 1",
    "ag19_summary": "with v as (select * from doc where quality = 1), s as (select source, count(*) n from v group by 1 order by n desc, source limit 1), l as (select lang, count(*) n from v group by 1 order by n desc, lang limit 3) select (select count(*) from v) verified, (select count(*) from doc where quality is null) unconfirmed, (select count(*) from doc where quality = 0) excluded, (select source from s) most_active, (select n from s) most_active_n, (select string_agg(lang || ' ' || n, ', ' order by n desc, lang) from l) categories",
    "ag15_by_source": "select source, count_if(lang = 'en') n from doc group by 1",
    "jo18_drift": "with f as (select doc_id, quality, sha256(text) v from doc), d as (select doc_id + case when doc_id % 60 = 0 then 10000000 else 0 end doc_id, sha256(case when doc_id % 9 = 0 then text || 'x' else text end) s from documents where doc_id % 3 = 0) select doc_id, case when v is null then 'missing' when coalesce(quality <> 1, true) then 'unconfirmed' when v <> s then 'changed' end issue from d left join f using (doc_id) where v is null or coalesce(quality <> 1, true) or v <> s",
    "jo19_refresh": "select doc_id, 'draft' origin from doc where doc_id % 4 = 0 union all select doc_id, 'added' from doc where quality = 1 and doc_id % 4 <> 0",
    "jo27_latest_audit": "select channel, role, length(arg_max(text, post_id)) chars, max(post_id) post_id from post group by 1, 2",
    "sk8_field_policies": "select channel, arg_max(text, post_id) filter (text <> '') as text, arg_min(role, post_id) as role from post group by 1",
    "fn9_heading_split": "select channel, post_id, case when length(split_part(text, chr(10), 1)) <= 80 then split_part(text, chr(10), 1) else '' end heading, case when length(split_part(text, chr(10), 1)) <= 80 then 'first_line' else 'none' end basis from post",
    "fn60_protected": "select doc_id, len(list_distinct(regexp_extract_all(text, '([A-Z]{2,}[0-9-]*|[0-9]+(?:[.,][0-9]+)?)', 1))) n from doc",
    "sk3_content_store": "select sha256(text) fingerprint, min(doc_id) doc_id from doc where doc_id % 2 = 1 and sha256(text) not in (select sha256(text) from doc where doc_id % 2 = 0) group by 1",
    "fn43_content_id": "select sha256(source || chr(10) || lang || chr(10) || n_chars) content_id, count(*) n, min(doc_id) first_doc from doc group by 1",
    "sc12_reassembly": "select doc_id, ceil(length(text) / 500)::bigint parts, true sound from doc where n_chars > 0",
}
