"""Queries over imports and exports: validation with row errors, gates, safe cells, research bundles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.text import safe_cell
from quotemill.operators import paste
from quotemill.session import shared_dir, table
from quotemill.sources import archives, decoding
from quotemill.sources.files import export_csv, read_delimited, read_records
from quotemill.sources.views import quote, rule


def _folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/quotemill-{uuid.uuid4().hex}"


def sk1_safe_export(spark: SparkSession, d: str) -> DataFrame:
    """Posts with what a spreadsheet would run made plain text."""
    p = table(spark, d, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" =1+"), "text")).otherwise(F.col("text"))
    return p.select("conv_id", "turn", safe_cell(text).alias("cell"))


def sc3_task_file(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written as delimited text and read back through the import scan."""
    path = _folder(spark)
    r = rule(spark, d)
    name = F.when(F.col("rule_id") % 5 == 0, F.concat("title", F.lit('; 2" bore'))).otherwise(F.col("title"))
    export_csv(r.select(F.col("rule_id").cast("string").alias("Article"), F.col("manufacturer").alias("BRAND"), name.alias("name")), path)
    back = read_delimited(spark, path, ["article", "manufacturer", "title"], {"brand": "manufacturer", "name": "title"})
    return back.where("error is null").select(F.col("article").cast("long").alias("article"), "manufacturer", "title")


def co14_validated_import(spark: SparkSession, d: str) -> DataFrame:
    """Price rows with their error codes: no product, no price, or a key that is there before."""
    q = quote(spark, d).select((F.col("rule_id") + F.when(F.col("line_no") == 7, 1_000_000).otherwise(0)).alias("rule_id"), "run_id", "line_no", F.when(F.col("status") != "no_price", F.col("price")).alias("price"), "source_id")
    known = rule(spark, d).select("rule_id", F.lit(True).alias("known"))
    w = Window.partitionBy("run_id", "line_no").orderBy("rule_id", "source_id", "price")
    j = q.join(known, "rule_id", "left").withColumn("k", F.row_number().over(w))
    errors = F.array_compact(F.array(F.when(F.col("known").isNull(), "unknown_product"), F.when(F.col("price").isNull(), "no_price"), F.when(F.col("k") > 1, "duplicate")))
    return j.select("run_id", "line_no", F.array_join(errors, ",").alias("errors")).groupBy("errors").agg(F.count("*").alias("n"))


def ag18_import_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, matched and unmatched, and their sums by tax basis."""
    q = quote(spark, d).join(rule(spark, d).where("size < 25").select("rule_id", F.lit(True).alias("hit")), "rule_id", "left")
    return q.groupBy("basis").agg(F.count("*").alias("rows"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"), F.sum("price").cast("double").alias("total"))


def sk11_batch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Batches (runs) that are visible: as many rows as declared, and not imported before."""
    q = quote(spark, d)
    declared = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 10 == 0, 99).otherwise(0).alias("extra"))
    there = q.groupBy("run_id").agg(F.count("*").alias("n"))
    done = q.where("run_id % 7 = 0").select("run_id").distinct()
    return there.join(declared, "run_id").where("extra = 0").join(done, "run_id", "left_anti").select("run_id", "n")


def jo13_priority_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A quote's product by id, else by its source as model number, accepted only if its size is within ten of that of
    the id's product, or that one is not known at all."""
    r = rule(spark, d)
    q = quote(spark, d).select("run_id", "line_no", "rule_id", "source_id").distinct()
    first = q.join(r.where("size % 3 <> 0").select("rule_id", F.col("title").alias("a")), "rule_id", "left")
    out = first.join(r.where("size < 30").select(F.col("rule_id").alias("source_id"), F.col("title").alias("b"), F.col("size").alias("b_size")), "source_id", "left")
    out = out.join(r.select("rule_id", F.col("size").alias("own_size")), "rule_id", "left")
    agrees = F.col("own_size").isNull() | (F.abs(F.col("own_size") - F.col("b_size")) <= 10)
    return out.select("run_id", "line_no", "rule_id", "source_id", F.coalesce("a", F.when(agrees, F.col("b"))).alias("title"))


def sk7_fenced(spark: SparkSession, d: str) -> DataFrame:
    """Enrichments are written where all six columns of the card are as they were, the stored revision is not newer and
    they change something. Here some cards have another title, category, size, price or brand by now."""
    r = rule(spark, d)
    card = lambda x: x.select("rule_id", F.struct("manufacturer", "title", "category", "size", "list_price", F.sha2(F.concat_ws("|", "title", "category"), 256).alias("hash")).alias("card"))
    every = lambda n: F.col("rule_id") % n == 0
    now = r.select("rule_id", F.when(~every(19), F.col("manufacturer")).alias("manufacturer"), F.when(F.col("size") == 13, F.upper("title")).otherwise(F.col("title")).alias("title"), F.when(every(7), "moved").otherwise(F.col("category")).alias("category"), F.when(every(17), F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(every(11), F.col("list_price") + 1).otherwise(F.col("list_price")).cast("decimal(18,2)").alias("list_price"))
    stored = r.where("rule_id % 2 = 0").select("rule_id", F.col("rule_id").cast("int").alias("revision"), F.upper("title").alias("payload"))
    new = r.select("rule_id", F.when(every(4), F.col("rule_id") - 1).otherwise(F.col("rule_id") + 1).cast("int").alias("revision"), F.when(every(6), F.upper("title")).otherwise(F.col("title")).alias("payload"))
    j = new.join(card(r), "rule_id").join(card(now).toDF("rule_id", "now"), "rule_id").where(F.col("card").eqNullSafe(F.col("now")))
    j = j.join(stored.toDF("rule_id", "old_revision", "old_payload"), "rule_id", "left")
    return j.where((F.col("old_revision").isNull() | (F.col("old_revision") <= F.col("revision"))) & ~F.col("payload").eqNullSafe(F.col("old_payload"))).select("rule_id", "revision", "payload")


def st4_stale(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose enrichment is missing or of another content."""
    r = rule(spark, d).select("rule_id", F.sha2(F.concat_ws("|", "title", "category"), 256).alias("hash"))
    done = rule(spark, d).where("rule_id % 3 <> 0").select("rule_id", F.sha2(F.concat_ws("|", F.when(F.col("rule_id") % 5 == 0, "old").otherwise(F.col("title")), "category"), 256).alias("done"))
    return r.join(done, "rule_id", "left").where(~F.col("hash").eqNullSafe(F.col("done"))).select("rule_id")


def jo21_supersession(spark: SparkSession, d: str) -> DataFrame:
    """A verified row supersedes the only candidate that agrees with it; several candidates stay."""
    r = rule(spark, d)
    candidate, verified = r.where("rule_id % 2 = 0"), r.where("rule_id % 2 = 1")
    j = verified.select(F.col("rule_id").alias("verified"), "manufacturer", "category", "size", "title").join(candidate, ["manufacturer", "category", "size", "title"])
    w = Window.partitionBy("verified")
    return j.withColumn("n", F.count("*").over(w)).where("n = 1").select("verified", F.col("rule_id").alias("superseded"))


def co12_bundle_errors(spark: SparkSession, d: str) -> DataFrame:
    """Research items with error codes: date and precision, source, repeated keys."""
    o = table(spark, d, "orders")
    item = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published"), F.when(F.col("o_orderkey") % 5 == 0, "month").otherwise("day").alias("precision"), F.when(F.col("o_orderkey") % 11 != 0, "https://example.org").alias("url"))
    shape = F.when(F.col("precision") == "day", F.col("published").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).otherwise(F.col("published").rlike("^[0-9]{4}-[0-9]{2}$"))
    errors = F.array_compact(F.array(F.when(~shape, "precision"), F.when(F.col("url").isNull(), "source")))
    return item.select(F.when(F.size(errors) == 0, "valid").otherwise(F.array_join(errors, "+")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def sk15_snapshot_meta(spark: SparkSession, d: str) -> DataFrame:
    """Rows and greatest id of a catalogue snapshot, read back from the JSON export."""
    path = _folder(spark)
    rule(spark, d).write.json(path, compression="gzip")
    back = spark.read.schema("rule_id long, manufacturer string, title string").json(path)
    return back.agg(F.count("*").alias("rows"), F.max("rule_id").alias("max_id"), F.count_distinct("manufacturer").alias("brands"))


def wi10_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Sheet rows under headings: the last heading of a brand's sheet applies."""
    r = rule(spark, d).withColumn("heading", F.when(F.col("rule_id") % 7 == 0, F.col("category")))
    w = Window.partitionBy("manufacturer").orderBy("rule_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.select("rule_id", F.last("heading", ignorenulls=True).over(w).alias("heading"))


# --- pasted lists


def _paste_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return rule(spark, d).select(F.col("rule_id").alias("entry_id"), F.col("manufacturer").alias("brand"), F.concat_ws(" ", "title", F.col("size").cast("string")).alias("model"), F.lpad(F.col("rule_id").cast("string"), 6, "0").alias("article"))


def fn13_pasted_lists(spark: SparkSession, d: str) -> DataFrame:
    """A paste for each order: its lines' models, articles, brands with models, titles without a size, or titles with an order
    number behind them, one after another with blanks, commas, line breaks and semicolons between, split and looked up."""
    c = _paste_catalogue(spark, d)
    named = F.element_at(F.array(F.col("model"), F.col("article"), F.concat_ws("  ", "brand", "model"), F.regexp_replace("model", " [0-9]+$", ""), F.concat_ws(" ", "model", F.col("run_id").cast("string"), F.lit("pcs"))), F.col("rate") % 5 + 1)
    gap = F.element_at(F.array(F.lit(" "), F.lit(", "), F.lit("\n"), F.lit(" ;")), F.col("source_id").cast("int") % 4 + 1)
    lines = quote(spark, d).join(c.withColumnRenamed("entry_id", "rule_id").hint("merge"), "rule_id").select("run_id", F.struct("line_no", "rule_id", "source_id", "price", F.concat(named, gap).alias("text")).alias("x"))
    pastes = lines.groupBy(F.col("run_id").alias("paste_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "").alias("text"))
    out = paste.resolve_pastes(pastes, c, ["model", "article"], F.concat_ws(" · ", "brand", "model", F.concat(F.lit("арт. "), "article")))
    return out.select("paste_id", "line", "part", "query", "status", "candidates", "entry_id")


# --- bytes in several encodings, archives of unlike files

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшхыз"


def sc15_decoded_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents in Cyrillic letters, as UTF-8, UTF-8 with a mark, Windows-1251 that the transport calls Latin-1, and KOI8-R
    that the page declares, by language; read back in the encoding of least damage."""
    docs = table(spark, d, "documents")
    text = F.regexp_replace(F.translate(F.lower("text"), LATIN, CYRILLIC), r"[^\x00-\x7Fа-яё]", "")
    name = F.when(F.col("lang") == "en", "utf-8").when(F.col("lang") == "de", "utf-8-sig").when(F.col("lang") == "fr", "cp1251").otherwise("koi8-r")
    page = docs.select("doc_id", name.alias("name"), F.concat(F.when(name == "koi8-r", "<meta charset=koi8-r>").otherwise(""), text).alias("page"))
    content = F.pandas_udf(_encoded, "binary")("page", "name")
    out = decoding.decoded(page.select("doc_id", "name", content.alias("content")), declared=F.when(F.col("name") == "cp1251", "ISO-8859-1"))
    return out.select("doc_id", "encoding", "damage", F.sha2("text", 256).alias("text_sha256"))


def _encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        for rows in decoding.pieces(*columns):
            yield pd.Series([None if t is None else t.encode(n, "replace") for t, n in rows])


def fn12_damage_score(spark: SparkSession, d: str) -> DataFrame:
    """Damage of each document's text, of its UTF-8 bytes read as Latin-1, and whether the score prefers the text."""
    text, wrong = F.col("text"), F.decode(F.encode("text", "utf-8"), "iso-8859-1")
    out = table(spark, d, "documents").select("doc_id", decoding.damage(text).alias("damage"), decoding.damage(wrong).alias("misread"))
    return out.withColumn("prefers_text", F.col("damage") < F.col("misread"))


#: Products of a file.
FILE_ROWS = 5_000
#: Archives whose files are of one brand.
ARCHIVE_BRANDS = {"brand7_shop": "Brand#7"}
ARCHIVE = r"/folder=([^/]*)/"


def _archives(spark: SparkSession, d: str) -> str:
    """The catalogue as a folder of archives: semicolons with a mark, commas with quoted cells and names over two lines,
    Windows-1251, and rows that are wrapped in one cell, too short, or without a name."""
    path = _folder(spark)
    r = rule(spark, d).withColumn("chunk", F.floor(F.col("rule_id") / FILE_ROWS))
    whole = F.concat_ws(" ", "manufacturer", "title")
    size, price = F.col("size").cast("string"), F.col("list_price").cast("string")
    line = F.concat_ws(";", F.when(F.col("size") % 9 == 0, "").otherwise(F.col("title")), F.lpad(F.col("rule_id").cast("string"), 7, "0"), size)
    kinds = {
        "brand7_shop": (F.col("manufacturer") == "Brand#7", "name;Артикул;Size, mm:", F.when(F.col("size") % 10 == 3, F.concat(F.lit('"'), line, F.lit('"'))).when(F.col("size") % 10 == 4, F.concat_ws(";", "title", size)).otherwise(line)),
        "marked": (F.col("size") < 15, "\ufeffname;Size, mm:;Type;price", F.concat_ws(";", whole, size, "category", price)),
        "quoted": (F.col("size") < 30, '"name",Type,link', F.concat_ws(",", F.concat(F.lit('"'), F.col("manufacturer"), F.lit(' ""'), F.replace("title", F.lit(" "), F.lit("\n")), F.lit('"""')), "category", F.concat(F.lit("https://example.org/"), F.col("rule_id").cast("string")))),
        "cyrillic": (F.lit(True), "name;Размер", F.concat_ws(";", F.concat(F.lit("Датчик "), F.when(F.col("size") % 7 != 0, whole).otherwise(F.col("title"))), size)),
    }
    folder = F.lit(None).cast("string")
    for name, (chosen, _, _) in kinds.items():
        folder = F.coalesce(folder, F.when(chosen, name))
    value = F.lit(None).cast("string")
    for name, (_, _, row) in kinds.items():
        value = F.coalesce(value, F.when(F.col("folder") == name, row))
    rows = r.withColumn("folder", folder).select("folder", "chunk", F.col("rule_id").alias("k"), value.alias("value"))
    heads = rows.select("folder", "chunk").distinct().withColumn("k", F.lit(-1).cast("long"))
    heads = heads.withColumn("value", F.try_element_at(F.create_map(*[F.lit(x) for name, (_, head, _) in kinds.items() for x in (name, head)]), F.col("folder")))
    lines = rows.unionByName(heads)
    raw = F.pandas_udf(_encoded, "binary")
    plain, other = lines.where("folder <> 'cyrillic'"), lines.where("folder = 'cyrillic'").withColumn("value", raw("value", F.lit("cp1251")).cast("string"))
    plain.unionByName(other).repartition("folder", "chunk").sortWithinPartitions("folder", "chunk", "k").select("folder", "chunk", "value").write.partitionBy("folder", "chunk").text(path)
    return path


def _judged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    records = read_records(spark, path, "*.txt")
    return records, archives.judged_records(records, ARCHIVE_BRANDS, [f"Brand#{i}" for i in range(40, 0, -1)], F.regexp_extract("file", ARCHIVE, 1))


def _chunk() -> F.Column:
    return F.regexp_extract("file", "/chunk=([0-9]+)/", 1).cast("long").alias("chunk")


def sc4_archives(spark: SparkSession, d: str) -> DataFrame:
    """The archives' attributes as one long table."""
    out = archives.attributes(_judged(spark, _archives(spark, d))[1])
    return out.select("source", _chunk(), "line", "brand", F.replace("article", F.lit("\n"), F.lit("|")).alias("article"), F.replace("title", F.lit("\n"), F.lit("|")).alias("title"), "product_url", "name", "value")


def ag23_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The archives' files with encoding, columns and records by state; a file's hash is 64 digits."""
    path = _archives(spark, d)
    records, judged = _judged(spark, path)
    out = archives.inventory(spark, path, records, judged, "*.txt")
    return out.select(F.regexp_extract("file", ARCHIVE, 1).alias("source"), _chunk(), F.length("sha256").alias("digits"), "encoding", "columns", "accepted", "unwrapped", "rejected_shape", "without_name", "outside_brand_scope")


_ARCHIVE = """f as (select *, rule_id // 5000 as chunk, case when manufacturer = 'Brand#7' then 'brand7_shop' when size < 15 then 'marked' when size < 30 then 'quoted' else 'cyrillic' end folder from rule),
  n as (select *, row_number() over (partition by folder, chunk order by rule_id) + 1 as line,
    case folder when 'brand7_shop' then nullif(title, '') when 'marked' then manufacturer || ' ' || title when 'quoted' then manufacturer || ' "' || replace(title, ' ', '|') || '"' else 'Датчик ' || case when size % 7 <> 0 then manufacturer || ' ' else '' end || title end full_name from f),
  j as (select *, case when folder = 'brand7_shop' and size % 10 = 4 then 'rejected_shape' when folder = 'brand7_shop' and size % 9 = 0 then 'without_name' when folder = 'cyrillic' and size % 7 = 0 then 'outside_brand_scope' else 'accepted' end state from n)"""

QUERIES = {f.__name__: f for f in (sk1_safe_export, sc3_task_file, co14_validated_import, ag18_import_report, sk11_batch_gate, jo13_priority_fallback, sk7_fenced, st4_stale, jo21_supersession, co12_bundle_errors, sk15_snapshot_meta, wi10_forward_fill, fn13_pasted_lists, sc15_decoded_files, fn12_damage_score, sc4_archives, ag23_inventory)}
SQL = {
    "sk1_safe_export": r"select conv_id, turn, case when regexp_matches(ltrim(t), '^[=+\-@]') then '''' || t else t end cell from (select conv_id, turn, case when turn % 2 = 0 then ' =1+' || text else text end t from conversations)",
    "sc3_task_file": """select rule_id article, manufacturer, case when rule_id % 5 = 0 then title || '; 2" bore' else title end title from rule""",
    "co14_validated_import": "with q as (select rule_id + case when line_no = 7 then 1000000 else 0 end rule_id, run_id, line_no, case when status <> 'no_price' then price end price, source_id from quote), j as (select *, rule_id in (select rule_id from rule) known, row_number() over (partition by run_id, line_no order by rule_id, source_id, price nulls first) k from q) select concat_ws(',', case when not known then 'unknown_product' end, case when price is null then 'no_price' end, case when k > 1 then 'duplicate' end) errors, count(*) n from j group by 1",
    "ag18_import_report": "select basis, count(*) as rows, count_if(rule_id in (select rule_id from rule where size < 25)) matched, count_if(rule_id not in (select rule_id from rule where size < 25)) unmatched, sum(price)::double total from quote group by 1",
    "sk11_batch_gate": "select run_id, count(*) n from quote where run_id % 10 <> 0 and run_id % 7 <> 0 and run_id in (select o_orderkey from orders) group by 1",
    "jo13_priority_fallback": "with q as (select distinct run_id, line_no, rule_id, source_id from quote) select run_id, line_no, q.rule_id, source_id, coalesce(a.title, case when c.rule_id is null or abs(c.size - b.size) <= 10 then b.title end) title from q left join rule a on q.rule_id = a.rule_id and a.size % 3 <> 0 left join rule b on q.source_id = b.rule_id and b.size < 30 left join rule c on c.rule_id = q.rule_id",
    "sk7_fenced": "select rule_id, (case when rule_id % 4 = 0 then rule_id - 1 else rule_id + 1 end)::int revision, case when rule_id % 6 = 0 then upper(title) else title end payload from rule where size <> 13 and rule_id % 7 <> 0 and rule_id % 11 <> 0 and rule_id % 17 <> 0 and rule_id % 19 <> 0 and (rule_id % 2 = 1 or (rule_id % 4 <> 0 and case when rule_id % 6 = 0 then upper(title) else title end <> upper(title)))",
    "st4_stale": "select rule_id from rule where rule_id % 3 = 0 or (rule_id % 5 = 0 and title <> 'old')",
    "jo21_supersession": "with j as (select v.rule_id verified, c.rule_id superseded, count(*) over (partition by v.rule_id) n from rule v join rule c using (manufacturer, category, size, title) where v.rule_id % 2 = 1 and c.rule_id % 2 = 0) select verified, superseded from j where n = 1",
    "co12_bundle_errors": "with i as (select o_orderkey % 9 = 0 short, o_orderkey % 5 = 0 monthly, o_orderkey % 11 = 0 bare from orders) select case when short = monthly and not bare then 'valid' else concat_ws('+', case when short <> monthly then 'precision' end, case when bare then 'source' end) end state, count(*) n from i group by 1",
    "sk15_snapshot_meta": "select count(*) as rows, max(rule_id) max_id, count(distinct manufacturer) brands from rule",
    "wi10_forward_fill": "select rule_id, last_value(case when rule_id % 7 = 0 then category end ignore nulls) over (partition by manufacturer order by rule_id rows unbounded preceding) heading from rule",
    "fn13_pasted_lists": r"""with recursive c as (select rule_id entry_id, manufacturer brand, title || ' ' || size model, title, lpad(rule_id::varchar, 6, '0') article from rule),
  q as (select run_id, line_no, rule_id, source_id, price, [model, article, brand || '  ' || model, title, model || ' ' || run_id || ' pcs'][rate % 5 + 1] || [' ', ', ', chr(10), ' ;'][source_id % 4 + 1] x from quote join c on entry_id = rule_id),
  p as (select run_id paste_id, regexp_split_to_array(string_agg(x, '' order by line_no, rule_id, source_id, price, x), '[\r\n\t;|]+') parts from q group by 1),
  names as (select entry_id, unnest([model, article, brand || ' ' || model, brand || ' ' || article]) a from c),
  k as (select distinct lower(regexp_replace(a, '\s+', '', 'g')) as key, entry_id from names),
  l as (select paste_id, line, trim(raw, ' ') t from (select paste_id, unnest(parts) raw, generate_subscripts(parts, 1) - 1 line from p) where trim(raw, ' ') <> ''),
  u as (select *, lower(regexp_replace(t, '\s+', '', 'g')) in (select key from k) whole, regexp_extract_all(t, '[^\s,]+') tok, regexp_extract_all(t, '[^\s,]+([\s,]*)', 1) gap from l),
  most as (select max(len(regexp_extract_all(a, '[^\s,]+'))) most from names),
  s as (select paste_id, line, i, unnest(range(1, least(most, len(tok) - i) + 1)) n, tok, gap from (select *, unnest(range(len(tok))) i from u, most where not whole)),
  sk as (select paste_id, line, i, n, array_to_string(list_transform(range(i + 1, i + n), lambda j: tok[j] || gap[j]), '') || tok[i + n] x from s),
  m as (select paste_id, line, i, max(n) n, arg_max(x, n) x from sk where lower(regexp_replace(x, '\s+', '', 'g')) in (select key from k) group by 1, 2, 3),
  walk as (select paste_id, line, 0::bigint a, 0::bigint b, null::varchar x, true known from u where not whole
    union all select w.paste_id, w.line, w.b, w.b + coalesce(m.n, 1), coalesce(m.x, u.tok[w.b + 1]), m.n is not null from walk w join u using (paste_id, line) left join m on m.paste_id = w.paste_id and m.line = w.line and m.i = w.b where w.b < len(u.tok)),
  st as (select w.*, w.known or coalesce(lag(w.known) over g, true) or (w.a > 0 and contains(u.gap[w.a], ',')) fresh from walk w join u using (paste_id, line) where w.b > 0 window g as (partition by w.paste_id, w.line order by w.a)),
  pt as (select *, sum(fresh::int) over (partition by paste_id, line order by a) - 1 part from st),
  parts as (select paste_id, line, part, string_agg(x, ' ' order by a) query from pt group by 1, 2, 3 union all select paste_id, line, 0, t from u where whole),
  f as (select paste_id, unnest(arg_min({line: line, part: part, query: query}, (line, part))), key from (select *, lower(regexp_replace(query, '\s+', '', 'g')) as key from parts) group by paste_id, key),
  e as (select entry_id, brand || ' · ' || model || ' · арт. ' || article label, lower(regexp_replace(model, '\s+', '', 'g')) mk, lower(regexp_replace(brand || ' · ' || model || ' · арт. ' || article, '\s+', '', 'g')) tx from c),
  sure as (select key, count(*) n, arg_min(entry_id, (not starts_with(mk, key), label, entry_id)) entry_id from k join e using (entry_id) group by 1),
  ask as (select distinct query, key from f where key not in (select key from k)),
  part as (select query, count(*) n, arg_min(entry_id, (not starts_with(mk, key), label, entry_id)) entry_id from ask join e on len(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: not contains(tx, w))) = 0 group by 1)
  select paste_id, line::int line, part::int part, f.query, case when sure.n = 1 then 'exact' when sure.n > 1 then 'ambiguous' when part.n > 0 then 'partial' else 'missing' end status, coalesce(sure.n, part.n, 0) candidates, coalesce(sure.entry_id, part.entry_id) entry_id
  from f left join sure using (key) left join part on part.query = f.query""",
    "sc15_decoded_files": f"""with t as (select doc_id, lang, case when lang in ('en', 'de', 'fr') then '' else '<meta charset=koi8-r>' end || regexp_replace(translate(lower(text), '{LATIN}', '{CYRILLIC}'), '[^\\x00-\\x7Fа-яё]', '', 'g') t from documents)
  select doc_id, case when t is null then null when lang in ('en', 'de') or not regexp_matches(t, '[^\\x00-\\x7F]') then 'utf-8' when lang = 'fr' then 'cp1251' else 'koi8-r' end as encoding, case when t is not null then 0 end as damage, sha256(t) text_sha256 from t""",
    "fn12_damage_score": r"""with t as (select doc_id, len(regexp_extract_all(text, '[\x{FFFD}ÐÑÃÂ]')) m, len(regexp_extract_all(text, '[À-ÿ]')) l, regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g') h from documents),
  s as (select *, len(regexp_extract_all(h, '(C2|C3|D0|D1) ')) wm, len(regexp_extract_all(h, '[C-F][0-9A-F] ')) wl from t)
  select doc_id, m + case when l >= 4 then l else 0 end damage, wm + case when wl >= 4 then wl else 0 end misread, m + case when l >= 4 then l else 0 end < wm + case when wl >= 4 then wl else 0 end prefers_text from s""",
    "sc4_archives": f"""with {_ARCHIVE} select folder as source, chunk, line, case when folder = 'brand7_shop' then 'Brand#7' else manufacturer end brand, case folder when 'brand7_shop' then lpad(rule_id::varchar, 7, '0') when 'quoted' then '"' || replace(title, ' ', '|') || '"' else title end article, full_name title,
    case when folder = 'quoted' then 'https://example.org/' || rule_id end product_url, a.x[1] as name, a.x[2] as value from j, lateral (select unnest(case folder when 'brand7_shop' then [['Артикул', lpad(rule_id::varchar, 7, '0')], ['Size, mm', size::varchar]] when 'marked' then [['Size, mm', size::varchar], ['Type', category]] when 'quoted' then [['Type', category]] else [['Размер', size::varchar]] end) x) a where state = 'accepted'""",
    "ag23_inventory": f"""with {_ARCHIVE} select folder as source, chunk, 64 digits, case when folder = 'cyrillic' then 'cp1251' else 'utf-8' end as encoding, case folder when 'marked' then 4 when 'cyrillic' then 2 else 3 end as columns, count_if(state = 'accepted') accepted, count_if(folder = 'brand7_shop' and size % 10 = 3) unwrapped, count_if(state = 'rejected_shape') rejected_shape, count_if(state = 'without_name') without_name, count_if(state = 'outside_brand_scope') outside_brand_scope from j group by 1, 2""",
}
