"""The Kneser-Ney model against plain Python, both ways to score, and what the bands reject."""

import math
import random
from collections import Counter, defaultdict

import pytest

from quotemill.llm import kneser_ney as kn
from quotemill.llm import quality_rules
from quotemill.llm.common import row_key

SCHEMA = "doc_id long, text string, lang string"


def texts():
    r = random.Random(7)
    vocabulary = ["the", "of", "a", "I", "straße", "日本", "ration", "tions", "edly", "ab"]
    out = [" ".join(r.choice(vocabulary) + r.choice(["", "", "s", "."]) for _ in range(60 + i)) for i in range(12)]
    return [*out, None, "", "  ", "short\ntext", " ".join(["$$ #x"] * 60), out[0], "ø" * 9 + "\n" + out[1]]


def chars_of(text):
    return [kn.START, kn.START, 32, *[ord(c) for c in "".join(w.decode() + " " for w in (text or "").encode().split())]]


def brute(learned, every):
    """log10 p of every 4-gram (context, d) of the texts."""
    grams = {4: Counter()}
    for text in learned:
        c = chars_of(text)
        grams[4].update(tuple(c[i - 3 : i + 1]) for i in range(3, len(c)))
    for k in (3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut = {k: kn.discounts(*[sum(c == j for c in grams[k].values()) for j in (1, 2, 3, 4)]) for k in grams}
    followers = {k: defaultdict(list) for k in grams}
    for k in grams:
        for g, c in grams[k].items():
            followers[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / (len(grams[1]) + 1)
        k = len(g)
        own = followers[k].get(g[:-1])
        if not own:
            return p(g[1:])
        c = grams[k].get(g, 0)
        return (c - (cut[k][min(c, 3) - 1] if c else 0)) / sum(own) + sum(cut[k][min(x, 3) - 1] for x in own) / sum(own) * p(g[1:])

    return {tuple(c[i - 3 : i + 1]): math.log10(p(tuple(c[i - 3 : i + 1]))) for c in map(chars_of, every) for i in range(3, len(c))}


def test_probabilities(spark):
    every = texts()
    learned = [t for t in every if t and len(t.split()) >= 50 and "$" not in t]
    want = brute(learned, every)
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(every)], SCHEMA).repartition(3).withColumn("key", row_key())
    for most in (10**6, 0):  # as sorted arrays, and by a join
        rows = {r["doc_id"]: r for r in quality_rules.measures(spark, docs, quality_rules.Rules(broadcast_grams=most, words=25)).collect()}
        assert len(rows) == len(every)
        for i, t in enumerate(every):
            c = chars_of(t)
            assert (rows[i]["n_units"] or 0) == len(c) - 3
            assert (rows[i]["log_p"] or 0) == pytest.approx(sum(want[tuple(c[j - 3 : j + 1])] for j in range(3, len(c))), rel=1e-5)


def test_bands_reject_gibberish_and_keep_text(spark):
    r = random.Random(3)
    vocabulary = [a + b for a in ("re", "ti", "an", "the", "on", "of") for b in ("", "er", "sh", "ing", "ed", "al", "is")]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(60, 300))), ("en", "xx")[i % 50 == 0]) for i in range(300)]
    rows += [(1000 + i, " ".join("".join(r.choice("qzxjwvk") for _ in range(6)) for _ in range(90)), "en") for i in range(5)]
    rows += [(2000 + i, " ".join(r.choice(vocabulary) + "%%%" for _ in range(90)), "en") for i in range(5)]
    rows += [(None, rows[1][1], None), rows[2], (3000, None, "en")]
    got = [(r["doc_id"], r["kept"]) for r in quality_rules.quality_rules(spark, spark.createDataFrame([(*x, "y") for x in rows], SCHEMA + ", kept string")).collect()]
    assert len(got) == len(rows)
    assert sorted(i for i, kept in got if not kept) == [*range(1000, 1005), *range(2000, 2005), 3000]
