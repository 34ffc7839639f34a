"""Codes are decoded by tables of rules, refused where their parts do not fit, and merged with what cards say."""

from quotemill.operators import designations as d


def fields(spark, rows):
    got = d.decoded(spark.createDataFrame(rows, "id int, maker string, code string"), "id", d.built_in(spark)).collect()
    return {(r.id, r.field): (r.text if r.number is None else r.number, r.standard, r.review) for r in got}


def test_codes(spark):
    rows = [(1, "PR", " pr18–5dn2 "), (2, "pr", "PR18-2DN"), (3, "sis", "PR18-5DN"), (4, "sis", "SIS-30V55-NONC-PNP-10,5-ST"), (5, "pr", "PR18-5DNX"), (6, None, "PR18-5DN"), (7, "pr", None), (8, "pr", "PRCM30-15DP"), (8, "pr", "PRCM30-15DP")]
    got = fields(spark, rows)
    assert {i for i, _ in got} == {1, 4, 8}
    assert {f: v for (i, f), v in got.items() if i == 1} == {
        "connection": ("cable", False, False), "diameter": (18.0, False, False), "pitch": (1.0, False, False), "sn": (5.0, False, False), "output": ("NPN", False, False), "function": ("NC", False, False), "mount": ("flush", False, False),
        "body_type": ("threaded", True, False), "voltage_type": ("DC", True, False), "load": (200.0, True, False), "ip": ("67", True, False),
    }
    assert got[4, "sn"] == (10.5, False, True) and (4, "pitch") not in got and (4, "review") not in got and got[4, "function"][0] == "NO/NC"
    assert got[8, "mount"][0] == "non-flush" and got[8, "connection"][0] == "connector" and got[8, "pitch"][0] == 1.5
    assert fields(spark, []) == {}


def test_merge(spark):
    cards = spark.createDataFrame([(1, "sn", 5.0, None, False), (1, "output", None, "PNP", False), (1, "mount", None, None, True), (1, "load", 100.0, None, False), (1, "length", 60.0, None, False)], "id int, field string, number double, text string, conflict boolean")
    found = d.decoded(spark.createDataFrame([(1, "pr", "PR18-5DN"), (2, "sis", "SIS-30V55-NO-PNP-10-ST"), (3, "pr", "PR18-5DN"), (3, "pr", "PR12-2DN")], "id int, maker string, code string"), "id", d.built_in(spark))
    got = {(r.id, r.field): (r.outcome, r.text if r.number is None else r.number) for r in d.enriched(cards, found, "id").collect()}
    assert got[1, "sn"] == ("confirmed", 5.0) and got[1, "output"] == ("conflict", None) and got[1, "mount"] == ("conflict", None)
    assert got[1, "load"] == ("card", 100.0) and got[1, "length"] == ("card", 60.0) and got[1, "function"] == ("filled", "NO") and got[1, "ip"] == ("filled", "67")
    assert got[2, "sn"] == ("review", None) and got[3, "sn"] == ("conflict", None) and got[3, "output"] == ("filled", "NPN")
