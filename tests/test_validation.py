"""Imports come back row by row with their faults, files pass whole or not at all; translations keep tokens and terms."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from quotemill import catalog
from quotemill.functions import text as t
from quotemill.operators import validation as v

TASK = "file string, line long, source string, manufacturer string, article string, product_url string, url_template string"
SOURCES = [("shop", "shop.example", "The Shop", "IFM-electronic"), ("shop", "shop.example", "The Shop", "Sick"), ("other", "other.example", "Other", "Sick")]


def tasks(spark, rows):
    sources = spark.createDataFrame(SOURCES, "source string, host string, label string, brand string")
    return v.validated_tasks(spark.createDataFrame(rows, TASK).withColumn("codes", F.lit("clash")), sources)


def test_task_faults(spark):
    ok = "https://shop.example/a"
    rows = [
        ("a", 1, " THE shop ", "ifm electronic", "X1", ok, None), ("a", 2, "shop.example", "IFM-Electronic", "X1", ok, ""),
        ("b", 1, None, "Sick", "X", ok, None), ("b", 2, "other", "ifm electronic", "X", ok, None), ("b", 3, "shop", "sick", "@x", ok, None),
        ("b", 4, "shop", "sick", "x" * 151, ok, None), ("b", 5, "shop", "sick", "X", ok, ok), ("b", 6, "shop", "sick", "X", None, " "),
        ("b", 7, "shop", "sick", "X", None, ok), ("b", 8, "shop", "sick", "X", None, "https://shop.example/{article}/{article}"), ("b", 9, "shop", "sick", "X", None, "https://shop.example/{article}/}"),
        ("b", 10, "shop", "sick", "X", "https://shop.example/" + "p" * 2100, None), ("b", 11, "shop", "sick", "X", "https://shop.example.evil.test/", None), ("b", 12, "shop", "sick", "X", "https://notshop.example/", None),
        ("b", 13, "shop", "sick", "X", "https://user@shop.example/", None), ("b", 14, "shop", "sick", "a\tb", ok, None),
        ("c", 1, "shop", "Sick", "X", None, "https://www.shop.example/{article}"), (None, 5, "shop", "Sick", "X", ok, None), (None, 6, "shop", "Sick", "X", ok, None),
    ]
    got = {(r.file, r.line): r for r in tasks(spark, rows).collect()}
    assert len(got) == len(rows)
    assert [got["b", i].code for i in range(1, 15)] == ["unknown_source", "unknown_brand", "article", "article", "one_address", "one_address", "template", "template", "template", "long_address", "address", "address", "address", "article"]
    assert (got["a", 1].source, got["a", 1].manufacturer, got["a", 1].code) == ("shop", "IFM-electronic", None)
    assert got["a", 2].code == "repeated" and not got["a", 1].released
    assert got["c", 1].released and got["c", 1].url == "https://www.shop.example/X"
    assert got[None, 5].code is None and got[None, 6].code == "repeated" and not got[None, 5].released
    assert tasks(spark, []).count() == 0


def test_item_faults(spark):
    at = dt.datetime(2026, 9, 10)
    runs = spark.createDataFrame([("r", "2026-09", at, at + dt.timedelta(days=2)), ("s", "2026-09", at, at)], "run string, period string, started timestamp, finished timestamp")
    known = spark.createDataFrame([("c",), ("c",)], "competitor string")
    base = dict(run="r", line=1, competitor="c", published="2026-09-05", precision="day", basis="heading", url="https://e.org/a", proof_url="https://E.org/a/#x", quote="the  quote", snapshot="so: the quote.", status="verified", discovered=at)
    changes = [
        {}, {"run": "none"}, {"run": None}, {"competitor": "x"}, {"published": "2026-09-31"}, {"published": "2026-09"}, {"precision": "month", "published": "2026-13"}, {"published": None}, {"published": "2026-08-05"},
        {"basis": None}, {"url": "https://"}, {"proof_url": None}, {"discovered": None}, {"status": None}, {"quote": " "}, {"snapshot": None}, {"quote": "other"}, {"url": "https://e.org/b"},
        {"url": "https://E.org/a"}, {"precision": "unknown", "published": None, "status": "candidate", "quote": None, "url": "https://e.org/c"}, {"run": "s"}, {"run": "none", "basis": None},
    ]
    schema = "run string, line long, competitor string, published string, precision string, basis string, url string, proof_url string, quote string, snapshot string, status string, discovered timestamp, period string"
    rows = [tuple((base | change | {"line": i, "period": "clash"})[c.split()[0]] for c in schema.split(", ")) for i, change in enumerate(changes)]
    items = spark.createDataFrame(rows, schema).drop("period")
    got = {r.line: r for r in v.validated_items(items, runs, known).collect()}
    assert [got[i].codes for i in range(len(changes))] == ["", "run", "run", "competitor", "date", "date", "date", "date", "period", "basis", "url,other_page", "proof,other_page", "instant", "status", "quote", "snapshot", "unproven", "other_page", "repeated", "", "", "run"]
    assert got[20].released and not got[0].released


def test_every_fault_is_met_in_the_tables(spark):
    codes = Counter(r.code for r in catalog.QUERIES["co14_task_rows"](spark, "/root/testdata/sf0.01").select("code").collect())
    assert set(codes) == {None, "unknown_source", "unknown_brand", "article", "one_address", "template", "long_address", "address", "repeated"}
    met = {c for r in catalog.QUERIES["co12_item_rows"](spark, "/root/testdata/sf0.01").select("codes").distinct().collect() for c in r.codes.split(",")}
    assert met == {"", "run", "competitor", "date", "period", "basis", "url", "proof", "instant", "status", "quote", "other_page", "snapshot", "unproven", "repeated"}


def test_translation_faults(spark):
    rows = [
        ("Inductive IME12 2,5 mm 24 VDC", "Индуктивный IME12 2.5 mm 24 VDC"), ("encoder 10 % and 10 %", "датчик 10%"), ("power controller", "Регулятор большой мощности"),
        (None, "IP67"), ("IP67", None), ("", ""), ("Capacitive", "Ёмкостный"),
    ]
    df = spark.createDataFrame(rows, "o string, x string").select(t.translation_faults(F.col("o"), F.col("x")).alias("f")).select("f.*")
    assert [tuple(map(list, r)) for r in df.collect()] == [([], [], []), (["10%"], [], ["encoder"]), ([], [], []), ([], ["67", "IP67"], []), (["67", "IP67"], [], []), ([], [], []), ([], [], [])]


def test_rows_are_made_once_for_repeats_and_gates(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        made.add(1)
        return name

    rows = [("a", 1, "k", []), ("a", 2, "k", []), ("a", 2, None, []), ("b", 1, "k", []), ("b", 1, "k", []), ("c", 1, None, []), ("c", 2, None, []), ("d", 1, "k", ["x"]), ("d", 2, "k", []), (None, 1, "k", []), (None, None, "k", [])]
    df = spark.createDataFrame(rows, "file string, line long, key string, codes array<string>").withColumn("key", counted("key"))
    got = {(r.file, r.line, r.key, tuple(r.codes), r.released) for r in v.judged(df, "file", ["key"], "line").collect()}
    again = ("repeated",)
    assert got == {("a", 1, "k", (), False), ("a", 2, "k", again, False), ("a", 2, None, (), False), ("b", 1, "k", (), True), ("c", 1, None, (), False), ("c", 2, None, again, False), ("d", 1, "k", ("x",), False), ("d", 2, "k", (), False), (None, 1, "k", (), True), (None, None, "k", (), True)}
    assert made.value == len(rows)
