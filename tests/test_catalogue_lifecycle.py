"""Lifecycle by manifests: the rules one by one, the batch fold against plain Python, the stream against the batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotemill.streaming import catalogue

START = datetime(2024, 1, 1)
SCHEMA = "rule_id long, source string, run_id string, at timestamp, obs_id long, effect string"


def at(days):
    return START + timedelta(days=days)


def states(spark, checks):
    """checks: (rule_id, day, effect), already confirmed by manifests."""
    rows = [(r, at(day), i, e) for i, (r, day, e) in enumerate(checks)]
    out = catalogue.fold(spark.createDataFrame(rows, "rule_id long, at timestamp, obs_id long, effect string"))
    return {r.rule_id: (r.state, r.missing, r.events) for r in out.collect()}


CASES = {
    1: ([(0, "active"), (1, "http"), (1.5, "http"), (3, "http")], ("archived", 2, 3)),
    2: ([(0, "active"), (1, "http"), (1.9, "http")], ("review", 1, 2)),
    3: ([(0, "active"), (1, "http"), (3, "variant")], ("review", 1, 3)),  # another kind begins anew
    4: ([(0, "active"), (1, "http"), (3, "http"), (4, "active")], ("active", 0, 4)),
    5: ([(0, "active"), (2, "discontinued")], ("discontinued", 0, 1)),
    6: ([(0, "http"), (2, "http")], ("new", 0, 0)),  # never seen, so nothing is absent
    7: ([(0, "active"), (1, "unlisted")], ("review", 0, 1)),
    8: ([(0, "active"), (1, "http"), (3, "http"), (9, "unlisted")], ("archived", 2, 3)),
    9: ([(0, "active"), (1, "http"), (2, "http")], ("archived", 2, 3)),  # a day apart to the microsecond
    10: ([(0, "active"), (1, "http"), (3, "http"), (5, "http")], ("archived", 3, 4)),
    11: ([(0, "active"), (1, "active"), (2, "active")], ("active", 0, 1)),
}


def test_rules(spark):
    got = states(spark, [(r, day, e) for r, (checks, _) in CASES.items() for day, e in checks])
    assert got == {r: want for r, (_, want) in CASES.items()}


def test_only_complete_manifests_confirm(spark):
    pages = [("s", "whole", "listing", True), ("s", "whole", "product", False), ("s", "open", "listing", True), ("s", "open", "sitemap", False), ("s", "open", "product", True), ("s", "bare", "listing", True), ("t", "whole", "product", True), ("s", "null", "listing", None), ("s", "null", "product", True)]
    runs = catalogue.manifests(spark.createDataFrame([(s, r, START, k, ok) for s, r, k, ok in pages], "source string, run_id string, at timestamp, kind string, ok boolean"))
    assert {(r.source, r.run_id): r.complete for r in runs.collect()} == {("s", "whole"): True, ("s", "open"): False, ("s", "bare"): False, ("t", "whole"): False, ("s", "null"): False}
    rows = [(1, "s", run, START, i, e) for i, (run, e) in enumerate([("whole", "http"), ("open", "http"), ("none", "variant"), ("open", "active"), ("whole", None)])]
    assert {r.obs_id for r in catalogue.gated(spark.createDataFrame(rows, SCHEMA), runs).collect()} == {0, 3}


def test_unlisted_products(spark):
    runs = spark.createDataFrame([("s", "a", True, at(1)), ("s", "b", False, at(2)), ("t", "a", True, at(3))], "source string, run_id string, complete boolean, closed timestamp")
    products = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "rule_id long, source string")
    listed = spark.createDataFrame([(1, "a"), (1, "a"), (3, "b")], "rule_id long, run_id string")
    assert {(r.rule_id, r.at) for r in catalogue.unlisted(products, listed, runs).collect()} == {(2, at(1)), (3, at(3))}


def test_moved_cards(spark):
    known = [(1, "s", "B", "A1", "u1"), (2, "s", "B", "A2", "u2"), (3, "s", "B", "A3", "u3"), (4, "s", "B", "A4", "u4"), (5, "s", "B", "A5", "u5"), (6, "s", "B", "A5", "u6"), (7, "s", "B", None, "u7"), (8, "s", "B", "A8", "same")]
    cards = [(10, "s", "B", "A1", "n1"), (11, "s", "B", "A2", "n2"), (12, "s", "B", "A3", "n3"), (13, "s", "B", "A4", "n4"), (14, "s", "B", "A5", "n5"), (15, "s", "B", None, "n7"), (16, "s", "B", "A8", "same"), (17, "s", "C", "A1", "n8")]
    schema = "x_id long, source string, brand string, article string, url string"
    fetches = spark.createDataFrame([("u1", 200, "n1"), ("u2", 410, None), ("u3", 200, "u3"), ("u4", 500, None)], "url string, status int, target string")
    aliases = spark.createDataFrame([(4, "n4"), (3, "elsewhere")], "rule_id long, url string")
    got = catalogue.moved(spark.createDataFrame(cards, schema).withColumnRenamed("x_id", "card_id"), spark.createDataFrame(known, schema).withColumnRenamed("x_id", "rule_id"), aliases, fetches)
    assert {r.card_id: (r.rule_id, r.evidence) for r in got.collect()} == {10: (1, "redirect"), 11: (2, "gone"), 12: (3, None), 13: (4, "alias")}


def random_checks(n, seed):
    r = random.Random(seed)
    kinds = ["active"] * 3 + ["http"] * 5 + ["variant"] * 2 + ["discontinued", "unlisted"]
    return [(r.randrange(12), r.randrange(40) / 2, r.choice(kinds)) for _ in range(n)]


def test_fold_equals_the_step_in_plain_python(spark):
    checks = random_checks(500, 4)
    want = {}
    for i in sorted(range(len(checks)), key=lambda i: (checks[i][1], i)):
        rule, day, effect = checks[i]
        want[rule], _ = catalogue.step(want.get(rule, ("new", 0, "", None, 0)), effect, int(day * catalogue.DAY))
    assert states(spark, checks) == {r: (s[0], s[1], s[4]) for r, s in want.items()}


def test_stream_equals_batch(spark, tmp_path):
    """Checks come in three files out of order, manifests behind them; a last day lets the watermark pass."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = [(r, day, e) for r, day, e in random_checks(150, 9) if e != "unlisted"]
    rows = [(r, "s", str(int(day)), at(day), i, e) for i, (r, day, e) in enumerate(kinds)]
    runs = [("s", str(k), k % 3 != 0, at(k + 0.9)) for k in range(20)]
    checks = spark.createDataFrame(rows, SCHEMA)
    manifests = spark.createDataFrame(runs, "source string, run_id string, complete boolean, closed timestamp")
    shuffled = random.Random(1).sample(rows, len(rows))
    where = [str(tmp_path / x) for x in ("checks", "runs", "out", "state")]
    steps = [(shuffled[:60], runs[:5]), (shuffled[60:110], runs[5:12]), (shuffled[110:], runs[12:]), ([(99, "s", "99", at(200), 10_000, "active")], [("s", "99", True, at(200.5))]), ([(99, "s", "99", at(300), 10_001, "active")], [("s", "999", True, at(300.5))])]
    for checks_part, runs_part in steps:
        spark.createDataFrame(checks_part, SCHEMA).coalesce(1).write.mode("append").parquet(where[0])
        spark.createDataFrame(runs_part, manifests.schema).coalesce(1).write.mode("append").parquet(where[1])
        c, r = spark.readStream.schema(checks.schema).parquet(where[0]), spark.readStream.schema(manifests.schema).parquet(where[1])
        query = catalogue.events(c, r, "60 days").writeStream.format("parquet").option("path", where[2]).option("checkpointLocation", where[3]).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(where[2]).where("rule_id < 99")
    want = catalogue.fold(catalogue.gated(checks, manifests))
    assert {r.rule_id: r.n for r in got.groupBy("rule_id").agg(F.count("*").alias("n")).collect()} == {r.rule_id: r.events for r in want.collect() if r.events}
    state = {r.rule_id: r.state for r in got.groupBy("rule_id").agg(F.max_by("state", "obs_id").alias("state")).collect()}
    assert set(state.values()) <= {"active", "discontinued", "review", "archived"}


@pytest.mark.parametrize("n", [0])
def test_nothing(spark, n):
    empty = spark.createDataFrame([], SCHEMA)
    runs = catalogue.manifests(empty.select("source", "run_id", "at", F.lit("x").alias("kind"), F.lit(True).alias("ok")))
    assert catalogue.fold(catalogue.gated(empty, runs)).count() == n
