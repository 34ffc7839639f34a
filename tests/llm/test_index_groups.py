"""Large index groups: what a set carries into each of its groups is bounded, and no pair is lost or there twice."""

import numpy as np
from pyspark.sql import functions as F

from quotemill.llm import jaccard_join
from quotemill.llm.common import signed


def test_sets_of_many_groups_carry_few_names_and_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    sets = {i: np.sort(rng.integers(0, 2**63, 40, np.uint64)) for i in range(2)}
    sets |= {i + 2: np.sort(np.append(sets[i][2:], rng.integers(0, 2**63, 2, np.uint64))) for i in range(2)}  # 2 like 0, 3 like 1
    names = signed(rng.integers(0, 2**63, 300, np.uint64))
    # 0 and 2 share 200 groups, of which the first are not among the least names of 0; 1 and 3 share the greatest name only
    held = {0: names[:250], 2: names[50:300], 1: np.append(np.sort(names)[:40], names.max()), 3: np.append(np.sort(names)[40:90], names.max())}
    member = spark.createDataFrame([(int(x), s, s) for s, xs in held.items() for x in np.unique(xs)], "name bigint, set_id bigint, label bigint")
    sized = spark.createDataFrame([(s, len(h), bytearray(jaccard_join.parity_bits(h))) for s, h in sets.items()], "set_id bigint, n bigint, bits binary")
    assert jaccard_join._dealt(member, sized).agg(F.max(F.size("names"))).first()[0] <= jaccard_join.CARRIED
    got = sorted(tuple(r) for r in jaccard_join._across(jaccard_join.Join(), member, sized).collect())
    assert got == [(0, 2), (1, 3)]
