"""Operators on small tables whose results are written out."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quotemill.functions import dates, prices, text, urls
from quotemill.operators import checks, history, matching
from quotemill.sources.files import read_delimited
from quotemill.streaming import lifecycle

SENSOR = "id long, brand string, family string, body_type string, diameter double, sn double, tmin double, tmax double, length double"


def values(df):
    return [tuple(r) for r in df.collect()]


def test_segments_break_at_failures(spark):
    df = spark.createDataFrame([(1, 1, "priced"), (1, 2, "network_error"), (1, 3, "priced")], "k int, t int, status string")
    assert sorted(values(history.segments(df, ["k"], ["t"], F.col("status") != "priced").select("t", "segment"))) == [(1, 0), (3, 1)]


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 50), (1, 6, 60), (1, 9, 90), (2, 7, 70)], "k int, at int, v int")
    assert sorted(values(history.as_of(left, right, ["k"], "t", "at", ["v"], ["v"])), key=str) == [(1, 5, 50), (1, 9, 90), (2, 5, None)]


def test_as_of_gives_equal_rows_once(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 5, "a"), (1, 5, None), (1, 5, None), (1, 1, "a"), (1, 1, "a"), (None, None, "a"), (None, None, "a"), (2, None, "a")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 50), (1, 5, 50), (1, 6, 60), (3, 1, 1)], "k int, at int, v int")
    out = history.as_of(left, right, ["k"], "t", "at", ["v"], ["v"], once=True)
    assert sorted(values(out), key=str) == sorted([(1, 5, "a", 50), (1, 5, "b", 50), (1, 5, None, 50), (1, 1, "a", None), (None, None, "a", None), (2, None, "a", None)], key=str)
    assert "HashAggregate" not in out._jdf.queryExecution().toString()


def test_guarded_upsert_keeps_the_first_success(spark):
    df = spark.createDataFrame([(1, 1, "error"), (1, 2, "priced"), (1, 3, "error"), (2, 1, "error"), (2, 2, "late")], "k int, t int, status string")
    assert sorted(values(history.upsert_guarded(df, ["k"], ["t"], F.col("status") == "priced"))) == [(1, 2, "priced"), (2, 2, "late")]


def test_wildcard_blocks_equal_the_or_condition(spark):
    rows = [(i, (None, "a", "b")[i % 3], (None, 1, 2, 1)[i % 4]) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, x string, y int")
    got = {(r["l"]["id"], r["r"]["id"]) for r in matching.wildcard_blocks(df, df, ["x", "y"]).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if all(p == q or p is None or q is None for p, q in zip(a[1:], b[1:]))}
    assert got == want


def pair(spark, candidate, reference=(1, "own", "inductive", "threaded", 18.0, 5.0, -45.0, 85.0, 60.0)):
    s = spark.createDataFrame([reference, candidate], SENSOR)
    row = F.struct(*s.columns)
    return s.where("id = 1").select(row.alias("l")).join(s.where("id = 2").select(row.alias("r")), F.lit(True))


def status(spark, profile="general", **change):
    base = dict(zip([c.split()[0] for c in SENSOR.split(", ")], (2, "x", "inductive", "threaded", 18.0, 5.0, -45.0, 85.0, 60.0)))
    return matching.evaluate(pair(spark, tuple((base | change).values())), profile).first()["status"]


def test_evaluation_statuses(spark):
    assert status(spark) == "direct"
    assert status(spark, diameter=30.0) == "incompatible"
    assert status(spark, tmin=-25.0) == "close"
    assert status(spark, "hot", tmin=-25.0) == "direct"
    assert status(spark, tmin=-60.0) == "direct"
    assert status(spark, diameter=None) == "review"
    assert status(spark, family=None) == "unsupported"
    assert status(spark, length=10.0) == "direct"
    odd = (1, "own", "inductive", "M18 threaded", 18.0, 5.0, -45.0, 85.0, 60.0)  # bodies are codes: another one is reviewed
    assert matching.evaluate(pair(spark, (2, "x", *odd[2:]), odd)).first()["status"] == "review"
    unknown = matching.evaluate(pair(spark, (2, "x", "inductive", "threaded", 18.0, None, -45.0, 85.0, 60.0))).first()
    assert unknown["status"] == "review" and float("inf") in unknown["risk"]


def test_pareto_layers(spark):
    df = spark.createDataFrame([("g", 1.0, 3.0), ("g", 2.0, 2.0), ("g", 2.0, 3.0), ("g", 3.0, 3.0), ("h", 9.0, 9.0)], "g string, a double, b double")
    assert sorted(values(matching.layers(df, ["g"], ["a", "b"]).select("g", "a", "b", "layer"))) == [("g", 1.0, 3.0, 1), ("g", 2.0, 2.0, 1), ("g", 2.0, 3.0, 2), ("g", 3.0, 3.0, 3), ("h", 9.0, 9.0, 1)]
    assert matching.first_layer(df, ["g"], ["a", "b"]).count() == 3
    lost = spark.createDataFrame([("g", 0.0, 9.0, 9.0, 5.0, 1), ("g", 1.0, 1.0, 1.0, 0.0, 0), ("g", 0.0, 9.0, 9.0, 5.0, 0), ("g", 0.0, 9.0, 9.0, 6.0, 0)], "g string, t double, a double, b double, gap double, spare long")
    got = matching.layers(lost, ["g"], ["a", "b"], "t", ["gap", "spare"]).select("t", "gap", "spare", "layer")
    assert sorted(values(got)) == [(0.0, 5.0, 0, 1), (0.0, 5.0, 1, 2), (0.0, 6.0, 0, 3), (1.0, 0.0, 0, 4)]  # temperature, risk, length, reserves
    assert values(matching.first_layer(lost, ["g"], ["a", "b"], "t", ["gap", "spare"]).select("t", "gap", "spare")) == [(0.0, 5.0, 0)]


def test_consensus_and_shares(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    assert sorted(values(checks.consensus(df, ["k"], "v")), key=str) == [(1, "a", False, 2), (2, None, True, 2), (3, None, False, 0)]
    assert values(checks.shares(df, "v", ["a", "z"])) == [("a", 3, 0.6), ("z", 0, 0.0), ("other", 2, 0.4)]


def test_price_functions(spark):
    df = spark.createDataFrame([("1 234,5 RUB",), ("100.05",), ("100 / 20 %",), ("0",), (None,)], "x string")
    assert [r[0] and float(r[0]) for r in df.select(prices.parse_money(F.col("x"))).collect()] == [1234.5, 100.05, None, None, None]
    assert float(spark.range(1).select(prices.with_tax(F.lit("100.05"), F.lit(22))).first()[0]) == 122.06
    terms = spark.createDataFrame([("120 с НДС 20 %",), ("120 без НДС, с НДС 20%",), ("10 excl. VAT 20 % or 10 % off per pack",), ("включая НДС 20%",), ("НДС 20 % или 10% НДС",)], "x string").select(prices.parse_terms(F.col("x")).alias("t")).collect()
    assert [tuple(r["t"]) for r in terms] == [("gross", 20, None), ("unknown", 20, None), ("net", 20, "pack"), ("gross", 20, None), ("unknown", None, None)]  # a rate stands beside the tax
    quote = "struct<price:decimal(18,2),currency:string,unit:string,basis:string,rate:int>"
    pairs = spark.sql(f"select from_json('{{\"price\":100,\"currency\":\"RUB\",\"unit\":\"piece\",\"basis\":\"net\",\"rate\":22}}', '{quote}') a, from_json('{{\"price\":183,\"currency\":\"RUB\",\"unit\":\"piece\",\"basis\":\"gross\",\"rate\":22}}', '{quote}') b")
    assert tuple(pairs.select(prices.delta("a", "b").alias("d")).first()["d"]) == (61.0, 50.0, "")


def test_text_and_urls(spark):
    one = spark.createDataFrame([("HTTP://Ex.org/A/?b=2&utm_x=1&a=1#f", "=1+1", "  Ёж   x: ")], "u string, c string, n string")
    got = one.select(urls.canonical(F.col("u")), text.safe_cell(F.col("c")), text.attribute_key(F.col("n")), urls.expand(F.lit("x/{article}"), F.lit("a b"))).first()
    assert tuple(got) == ("http://ex.org/A?a=1&b=2", "'=1+1", "еж x", "x/a%20b")


def test_delimited_files_with_quotes_and_old_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffarticle;brand\n1;"a;b"\n2;"say ""x"""\n;y\n', "utf-8")
    (tmp_path / "b.csv").write_bytes("article\tbrand\n3\tДатчик\n".encode("cp1251"))
    rows = read_delimited(spark, str(tmp_path), ["article", "brand"]).select("article", "brand", "error").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("1", "a;b", None), ("2", 'say "x"', None), (None, "y", None), ("3", "Датчик", None)], key=str)


def test_dates_that_publishers_write(spark):
    texts = ["2026-01-05T10:00", "Опубликовано 5.1.2026", "5 января 2026", "January 5, 2026", "5 Jan 2026", "2026.13.01", "31.02.2026", "модель 18x1", None, "5 мая 2026"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(dates.parse_date(F.col("x")).cast("string").alias("d"), dates.announced_month(F.col("x")).cast("string").alias("m"))
    rows = df.collect()
    assert [r["d"] for r in rows] == ["2026-01-05"] * 5 + [None] * 4 + ["2026-05-05"]
    assert [r["m"] for r in rows] == [None, None, "2026-01-01", None, None, None, None, None, None, "2026-05-01"]


def test_delimited_files_reject(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Brand,Article\nx,1\n\ny,2,3\n")
    (tmp_path / "b.csv").write_text("Brand;Colour\nx;1\n")
    rows = read_delimited(spark, str(tmp_path), ["brand", "article"]).select("line", "error", "brand", "article").collect()
    assert set(map(tuple, rows)) == {(2, None, "x", "1"), (2, "unknown_header", None, None), (4, "value_without_header", "y", "2")}


CHECKS = [(1, 0, 1, "priced"), (1, 1, 2, "not_found"), (1, 1.5, 3, "not_found"), (1, 3, 4, "not_found"), (1, 4, 5, "priced"), (2, 0, 6, "not_found"), (2, 9, 7, "network_error")]


def test_lifecycle_fold(spark):
    df = spark.createDataFrame([(r, datetime(2024, 1, 1) + timedelta(days=t), i, s) for r, t, i, s in CHECKS], "rule_id long, checked_at timestamp, obs_id long, status string")
    assert sorted(values(lifecycle.fold(df))) == [(1, "active", 0, 4), (2, "review", 1, 1)]
    assert lifecycle.fold(df.limit(0)).count() == 0


def test_lifecycle_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "rule_id long, at double, obs_id long, status string"
    for k, part in enumerate((CHECKS[:3], CHECKS[3:])):
        spark.createDataFrame([(r, float(t * 86400), i, s) for r, t, i, s in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = lifecycle.events(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("obs_id", "event").collect()
    assert sorted(map(tuple, got)) == [(1, "discovered"), (2, "review"), (4, "archived"), (5, "restored"), (6, "review")]


def test_page_states(spark):
    from quotemill.plans.pages import page_states

    body = "<body><p>" + "word " * 20 + "</p></body>"
    pages = {
        1: "<html><title>A sensor</title>" + body,
        2: "<title>A sensor</title><body><script src='x.js'></script></body>",
        3: "<title> Page  NOT found </title>" + body,
        4: "<title>A</title><h1 class='x'>404 <b>Not Found</b></h1>" + body,
        5: "<title>A</title><body>" + "word " * 20 + "The resource you are looking for doesn't exist.</body>",
        6: "<title>Just a moment...</title>" + body,
        7: "<title>A</title><body>" + "word " * 20 + "Generated by CloudFront (x)</body>",
        8: "<title>Not found in our shop: sensors</title>" + body,
        9: None,
    }
    found = dict(page_states(spark.createDataFrame(list(pages.items()), "page_id long, html string")).collect())
    assert found == {1: "ok", 2: "not_loaded", 3: "not_found", 4: "not_found", 5: "not_found", 6: "blocked", 7: "load_error", 8: "ok", 9: "ok"}


def test_blocks_with_keys_that_only_the_left_side_may_leave_open(spark):
    rows = [(i, x, y, z) for i, (x, y, z) in enumerate((x, y, z) for x in (None, 1, 2) for y in (None, 1) for z in (None, "a", "b"))]
    df = spark.createDataFrame(rows + rows[:2], "id int, x int, y int, z string")
    got = sorted((p["l"]["id"], p["r"]["id"]) for p in matching.wildcard_blocks(df, df, ["x"], ["y", "z"]).collect())
    agree = lambda a, b: (a[1] == b[1] or None in (a[1], b[1])) and all(a[k] is None or a[k] == b[k] for k in (2, 3))
    assert got == sorted((a[0], b[0]) for a in rows + rows[:2] for b in rows + rows[:2] if agree(a, b))


def test_few_keys_are_many_tasks(spark):
    """Pairs of one key were one task's work, and one side was broadcast."""
    df = spark.range(2000).selectExpr("id", "if(id >= 0, null, 1) as x", "if(id >= 0, 1, 2) as y")
    blocks = matching.wildcard_blocks(df.where("id % 100 = 0"), df, ["x", "y"])
    assert "Broadcast" not in blocks._jdf.queryExecution().executedPlan().toString()
    parts = {r[0]: r[1] for r in blocks.groupBy(F.spark_partition_id()).count().collect()}
    assert sum(parts.values()) == 40000
    assert len(parts) > 20
    assert max(parts.values()) < 8000
