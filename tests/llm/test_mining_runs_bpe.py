"""Hard negatives, periodic runs and the BPE replay against plain Python: nulls, empty and long texts, ties, repeated rows,
empty tables, clashing columns."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quotemill.llm import bpe_replay, hard_negatives, periodic_runs

DOCS = "doc_id long, text string, ids string, words string, rid long, chunk int, tile string"


def texts():
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "be", "gamma", "it's", "Ünïcode", "naïve", "日本語", "x1", "3.14", "--"])
    plain = [" ".join(word() for _ in range(n)) for n in (0, 1, 3, 24, 90, 400)]
    odd = [None, "", " ", "  \t\n ", " leading", "trailing ", "a  b   c", "x y z\x1cq", " 　 \x85", "'s't're'S", "aaaa" * 40, "😀😀 é", "\x00\x01", "<|endoftext|> </s>", "ab" * 3000, " ".join(["lorem"] * 4000)]
    periodic = []
    for period, times, lead in ((1, 24, 0), (1, 23, 2), (2, 12, 1), (5, 5, 7), (8, 3, 3), (9, 3, 0), (40, 4, 11), (300, 3, 20), (700, 7, 1)):
        unit = [f"w{r.randrange(10**6)}" for _ in range(period)]
        periodic.append(" ".join([f"l{i}" for i in range(lead)] + unit * times + unit[: period // 2] + [f"t{i}" for i in range(lead)]))
    two = ["a b"] * 30 + ["c d e"] * 20 + ["a b"] * 30
    return plain + odd + periodic + [" ".join(two), " ".join((["p"] * 30 + ["q"]) * 5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1, 2, "z") for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, rows[30][1], "x", "y", 1, 2, "z"), (None, None, None, None, None, None, None), (7, "another text of seven", "x", "y", 1, 2, "z")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def brute_runs(doc_id, text, change):
    words = change(doc_id, (text or "").encode().split())
    known = {}
    x = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found = {}
    for q in range(1, len(words) // 3 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2).tolist():
            if b + q - a >= max(24, 3 * q):
                found.setdefault((a, b + q - a), q)
    runs = sorted((a, q, n) for (a, n), q in found.items())
    drop = {i for a, q, n in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    top = (best[0], best[2], best[1], math.floor(1000 * Fraction(best[2], best[1]))) if best else (None,) * 4
    said = "".join(f"{a},{n},{q}\n" for a, q, n in runs)
    return (doc_id, len(runs), *top, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


@pytest.mark.parametrize("change", [periodic_runs.planted, periodic_runs.unchanged])
def test_periodic_runs_equal_brute_force(spark, docs, change):
    got = periodic_runs.run_digests(*periodic_runs.periodic_runs(spark, docs, change))
    rows = docs.collect()
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_runs(r.doc_id, r.text, change) for r in rows)


def test_periodic_runs_of_nothing(spark, docs):
    assert periodic_runs.run_digests(*periodic_runs.periodic_runs(spark, docs.limit(0))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 14), st.integers(0, 3)), min_size=1, max_size=5))
def test_tiles_find_every_run(parts):
    r = random.Random(len(parts))
    words = []
    for period, times, letters in parts:
        words += [str(r.randrange(1 + letters)).encode() for _ in range(period)] * times
    flat, again = periodic_runs._word_numbers([words])
    pieces = []
    for _, octave, a, b, first, cut in periodic_runs._tiles([len(words)], again):
        pieces += [(q, a + s, a + e) for q, s, e in periodic_runs.solve(flat[a:b].tolist(), octave, first - a, periodic_runs.BOUNDARIES, cut - a)]
    whole = {}
    for q in {p[0] for p in pieces}:
        covered = sorted({i for p, s, e in pieces if p == q for i in range(s, e)})
        for k, i in enumerate(covered):
            if not k or covered[k - 1] != i - 1:
                start = i
            if k + 1 == len(covered) or covered[k + 1] != i + 1:
                n = i + 1 + q - start
                if n >= max(24, 3 * q):
                    whole[start, n] = min(q, whole.get((start, n), q))
    want = brute_runs(None, b" ".join(words).decode(), periodic_runs.unchanged)
    said = "".join(f"{a},{n},{q}\n" for a, q, n in sorted((a, q, n) for (a, n), q in whole.items()))
    assert hashlib.sha256(said.encode()).hexdigest() == want[6]


def tiktoken_rows(rows):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=bpe_replay.default_pattern(), mergeable_ranks=bpe_replay.read_ranks(bpe_replay.default_path()), special_tokens={})
    return [(r.doc_id, own.encode_ordinary(r.text or "")) for r in rows]


@pytest.mark.parametrize("sizes", [{}, {"chunk_chars": 300, "part_chars": 2000, "block_bytes": 100}])
def test_bpe_equals_tiktoken(spark, docs, sizes):
    encoded = bpe_replay.encode_documents(spark, docs, **sizes)
    rows = docs.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in bpe_replay.id_lists(encoded).collect()) == Counter((i, tuple(x)) for i, x in tiktoken_rows(rows))
    back = bpe_replay.decode_documents(encoded)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in rows)
    digests = bpe_replay.token_digests(encoded).collect()
    assert Counter(map(tuple, bpe_replay.encoded_digests(spark, docs).collect())) == Counter(map(tuple, digests))
    assert Counter(tuple(r) for r in digests) == Counter((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t.text or "").encode()).hexdigest()) for (i, x), t in zip(tiktoken_rows(rows), rows, strict=True))


def test_bpe_of_nothing_and_of_unknown_ids(spark, docs):
    assert bpe_replay.encode_documents(spark, docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert {r.n_tokens for r in bpe_replay.token_digests(nulls).collect()} == {0}
    with pytest.raises(Exception, match="KeyError"):
        bpe_replay.decode_documents(spark.createDataFrame([(1, bytearray((50256).to_bytes(4, "little")))], "doc_id long, ids binary")).collect()


def test_varints():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1, 5], np.int64)
    assert bpe_replay.from_varints(bpe_replay.to_varints(x)).tolist() == x.tolist()
    assert bpe_replay.from_varints(bpe_replay.to_varints(x[:0])).tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeхтн 'é1\n", min_size=1, max_size=30), min_size=1, max_size=20, unique=True))
def test_replay_of_any_pieces(pieces):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=bpe_replay.read_ranks(bpe_replay.default_path()), special_tokens={})
    assert bpe_replay.replay([p.encode() for p in pieces], bpe_replay.default_path()) == [own.encode_ordinary(p) for p in pieces]


def test_a_merge_of_lower_rank_comes_first(tmp_path):
    """Ranks that no training gives: joining x and ab (rank 256) comes up only after ab (rank 300) is made, twice in a piece."""
    import base64

    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"xab": 256, b"ab": 300, b"abx": 299}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    pieces = [b"abxab", b"xabxabab", b"ababxab", b"xabx"]
    assert bpe_replay.replay(pieces, str(path)) == [own.encode_ordinary(p.decode()) for p in pieces]


def brute_negatives(rows, every=4, positives=5, negatives=10):
    clean = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (label, [math.floor(256 * x) for x in v])
        clean[i] = min(clean.get(i, new), new)
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (label, v) in clean.items():
        if i % every:
            continue
        scored = sorted((-score(v, w), j, other == label) for j, (other, w) in clean.items() if j != i)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(j, -t) for t, j, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, p, k + 1, j, -s, t) for k, (j, t) in enumerate(fits[:negatives])]
    return out


def vectors(kind):
    r = np.random.default_rng(3)
    if kind == "lengths":  # a few long rows, many short ones
        x = r.normal(size=(600, 8)) * np.exp(r.normal(size=(600, 1)) * 1.5)
    elif kind == "clusters":  # narrow ranges of coordinates
        x = np.repeat(np.eye(8)[r.integers(0, 8, 60)], 10, axis=0) + r.normal(size=(600, 8)) * 0.05
    else:  # ties: few different vectors, zeros among them
        x = r.integers(-1, 2, size=(12, 3))[r.integers(0, 12, 600)].astype(float) * 0.3
    rows = [(i, v, int(label)) for i, (v, label) in enumerate(zip(x.astype(np.float32).astype(float).tolist(), r.integers(0, 4, 600), strict=True))]
    width = len(rows[0][1])
    rows += [(600, None, 1), (604, [None] * width, 1), (608, [float("nan")] * width, 1), (612, [float("inf")] * width, 1), (616, [0.0] * width, None), (None, [1.0] * width, 1), (620, [0.0] * width, 2), (624, [], 1), (628, [0.5], 1), rows[4], rows[4], (8, [0.1] * width, 0)]
    return rows


@pytest.mark.parametrize("kind", ["lengths", "clusters", "ties"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, name string, v int").repartition(3)
    got = hard_negatives.hard_negatives(spark, df, every=4, shard_rows=70, block_anchors=40)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_negatives(rows))
    assert hard_negatives.hard_negatives(spark, df.limit(0)).count() == 0


def test_coordinate_ranges_lose_no_row():
    """Every row at an angle within the bound lies in all feasible ranges."""
    r = np.random.default_rng(11)
    x = np.round((np.repeat(np.eye(6)[r.integers(0, 6, 50)], 8, axis=0) + r.normal(size=(400, 6)) * 0.1) * 256).astype(np.int64)
    bucket = hard_negatives.Bucket(np.arange(400), np.zeros(400, int), x, np.sqrt((x**2).sum(1)))
    narrow = 0
    for a in range(40):
        unit = bucket.unit[a]
        for need in (0.2, 0.7, 0.95, 0.999):
            rows = hard_negatives.feasible(bucket, unit, need)
            if rows is not None:
                narrow += 1
                assert set(np.flatnonzero(bucket.unit @ unit >= need + 1e-9)) <= set(rows.tolist())
    assert narrow > 40
