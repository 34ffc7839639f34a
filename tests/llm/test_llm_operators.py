"""Training-data operators against plain Python on small tables: nulls, empty texts, long texts, ties, repeated rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import chat_format, decontaminate, huffman_tokens, jaccard_join, language_id, lm_scoring, packing, quality_classifier, quality_rules, subword_lm, suffix_dedup
from quotemill.llm.graph import add_links, connected_components
from quotemill.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, part int"
VOCABULARY = [a + b for a in ("re", "ti", "an", "the", "on") for b in ("er", "sh", "ing", "ed", "al", "is")]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Random documents, copies, near copies, a shared passage, nulls, empty and long texts, repeated rows."""
    passage, base = words(120, 900), words(150, 901)
    texts = [" ".join(words(5 + 13 * i, i)) for i in range(24)]
    texts += [" ".join(base)] * 4
    for k in range(8):
        near = list(base)
        near[10 + 7 * k] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(words(40, 50 + i) + passage + words(30, 80 + i)) for i in range(6)]
    texts += [None, "", "   ", "one", "One", "two words", "a b c d", "!!! ???", " ".join(words(4000, 77)), "Ünïcödé  \n\n x"]
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 4}", len(t or ""), i, 1) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[25], (None, "no id " * 60, "en", "s", 0, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def tokens(text):
    return (text or "").encode().lower().split()


def sets(text, size=5):
    w = tokens(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    s = [(r[0], sets(r[1])) for r in rows]
    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {a: find(a) for a, _ in s}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (20, 21), (3, 3)], "a long, b long")
    labels = connected_components(spark, edges)
    assert dict(map(tuple, labels.collect())) == {1: 1, 2: 1, 3: 1} | dict.fromkeys(range(4, 10), 4) | {20: 20, 21: 20}
    more = add_links(spark, labels, spark.createDataFrame([(9, 21), (30, 31)], "a long, b long"))
    assert dict(map(tuple, more.collect())) == {1: 1, 2: 1, 3: 1} | dict.fromkeys([*range(4, 10), 20, 21], 4) | {30: 30, 31: 30}
    assert connected_components(spark, edges.limit(0)).count() == 0


def test_jaccard_join(spark, docs, empty):
    rows = [r for r in corpus() if r[0] is not None]
    want = brute_components(rows)
    got = jaccard_join.jaccard_components(spark, docs.where("doc_id is not null")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(len(sets(rows[r["doc_id"]][1])) == r["n_shingles"] for r in got)
    assert jaccard_join.jaccard_components(spark, empty).count() == 0


def test_pairs_always_share_an_index_entry():
    """The pigeonhole guarantee, with and without costs, for sets of many sizes at the edge of the similarity."""
    r = np.random.default_rng(0)
    for n in [*range(3, 40), 63, 64, 65, 127, 128, 200, 511, 700]:
        for _ in range(4):
            base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            m = r.integers(jaccard_join.bounds(n, 75)[0], jaccard_join.bounds(n, 75)[1] + 1)
            out = jaccard_join.most_apart(n, int(m), 75)
            lost = max(0, (out + n - m) // 2)
            other = np.unique(np.concatenate([r.permutation(base)[lost:], r.integers(0, 2**63, m - n + lost).astype(np.uint64)]))
            shared = len(np.intersect1d(base, other))
            if 100 * shared < 75 * (len(base) + len(other) - shared) or len(base) == len(other) == shared:
                continue
            some = np.sort(np.concatenate([jaccard_join.level_subsets(base, level)[0][::2] for level in (jaccard_join.band(n), jaccard_join.band(n) - 1)]))
            for costs in ((np.zeros(0, np.uint64), np.zeros(0, np.int64)), (some, np.arange(len(some)) % 5 + 2)):
                a, b = (np.concatenate(jaccard_join.index_entries(x, 75, costs)) for x in (base, other))
                assert len(np.intersect1d(a, b)), (n, m)


def test_parity_bits_never_exceed_the_difference():
    r = np.random.default_rng(1)
    for n, m in ((5, 6), (40, 90), (300, 300)):
        a, b = (np.unique(r.integers(0, 2**63, k).astype(np.uint64)) for k in (n, m))
        b[: n // 2] = a[: n // 2]
        b = np.unique(b)
        assert jaccard_join.unequal_bits(jaccard_join.parity_bits(a), jaccard_join.parity_bits(b)) <= len(np.setxor1d(a, b))


def brute_cut(rows, length):
    where = defaultdict(list)
    texts = [(r[1] or "").encode() for r in rows]
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            where[t[i : i + length]].append((k, i))
    covered = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        for k, i in places if len(places) > 1 else []:
            covered[k][i : i + length] = True
    return texts, covered


def test_suffix_dedup(spark, docs, empty):
    rows = corpus() + [(500, "ab" * 900, "en", "s", 0, 0, 0), (501, "x" * 450, "en", "s", 0, 0, 0)]
    more = docs.unionByName(spark.createDataFrame(rows[-2:], SCHEMA))
    texts, covered = brute_cut(rows, 400)
    want = Counter()
    for r, t, c in zip(rows, texts, covered):
        left = bytes(np.frombuffer(t, np.uint8)[~c]) if len(t) else b""
        want[(r[0], len(t), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())] += 1
    got = suffix_dedup.suffix_dedup(spark, more).drop("kept")
    assert Counter(map(tuple, got.collect())) == want
    assert suffix_dedup.suffix_dedup(spark, empty).count() == 0
    cut = suffix_dedup.cut_repeats(spark, more)
    assert cut.columns == more.columns and cut.count() == len(rows)


def test_suffix_windows_for_large_groups():
    """The class method for large groups agrees with the pairwise one for small groups."""
    r = random.Random(3)
    core = bytes(r.randrange(97, 99) for _ in range(500))
    group = sorted((core[200 : 200 + r.randrange(60, 300)] + bytes([r.randrange(97, 99)]) * 40, core[200 - r.randrange(20, 90) : 200]) for _ in range(6))
    items = [(right, suffix_dedup.first_difference(group[i - 1][0], right, 0) if i else 0, left) for i, (right, left) in enumerate(group)]

    def covered(ranges):
        return [{j for a, b in x for j in range(a, b + 1)} for x in ranges]

    small = covered(suffix_dedup.repeated_windows(items, 100))
    twice = sorted(items + [(items[0][0][:32], 0, b"")] * 3, key=lambda x: x[0])
    twice = [(x[0], suffix_dedup.first_difference(twice[i - 1][0], x[0], 0) if i else 0, x[2]) for i, x in enumerate(twice)]
    large = covered(suffix_dedup.repeated_windows(twice, 100))
    assert sorted(map(sorted, small)) == sorted(sorted(x) for x, t in zip(large, twice) if t[2])


def test_loser_tree_merges_in_order():
    r = random.Random(5)
    pool = [bytes(r.randrange(97, 99) for _ in range(r.randrange(1, 40))) for _ in range(200)]
    runs = [sorted((x, b"", 1, 0) for x in pool[k::7]) for k in range(7)]
    out = list(suffix_dedup.merged([suffix_dedup.front_decoded(suffix_dedup.front_coded(x)) for x in runs]))
    assert [x[0] for x in out] == sorted(pool)
    assert all(b[1] == suffix_dedup.first_difference(a[0], b[0], 0) for a, b in zip(out, out[1:]))


def test_decontaminate(spark, docs, empty):
    items = [(1, " ".join(words(120, 900)[20:60]), "x"), (2, "two words", "x"), (3, None, "x"), (4, " ".join(words(30, 4040)), "x"), (1, " ".join(words(120, 900)[20:60]), "x")]
    held = spark.createDataFrame(items, "item_id long, text string, lang string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 6), r["start"]) for r in decontaminate.find_items(spark, docs, held).collect()}
    want = {}
    for doc_id, text, *_ in corpus():
        w = (text or "").lower().split()
        for item_id, item, _ in items:
            v = (item or "").split()
            k = min(5, len(v))
            if not v:
                continue
            y = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
            for at in range(max(1, len(w) - len(v) + 1)):
                x = Counter(tuple(w[at : at + len(v)][i : i + k]) for i in range(min(len(v), len(w) - at) - k + 1))
                both = sum((x & y).values())
                s = both / max(1, sum(x.values()) + sum(y.values()) - both)
                if s >= 0.75 and s > want.get((doc_id, item_id), (0,))[0]:
                    want[(doc_id, item_id)] = (s, at)
    assert got == {k: (round(a, 6), b) for k, (a, b) in want.items()} and len(want) >= 7
    assert decontaminate.find_items(spark, empty, held).count() == 0
    assert decontaminate.find_items(spark, docs, held.limit(0)).count() == 0
    assert decontaminate.decontaminate(spark, docs, held).columns == docs.columns


def test_quality_rules(spark, docs, empty):
    got = quality_rules.quality_rules(spark, docs.where("doc_id is not null")).collect()
    rows = [r for r in corpus() if r[0] is not None]
    want = []
    for r in rows:
        w, text = tokens(r[1]) and (r[1] or "").encode().split(), r[1] or ""
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        n = len(w)
        want.append((r[0], n, sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n))
    assert Counter(tuple(r)[:7] for r in got) == Counter(want)
    assert not any(r["kept"] for r in got if r["base_failed"])
    odd = spark.createDataFrame([(10_000, " ".join("qzxj"[i % 4] * 7 + "wvk" for i in range(3, 90)) + " #" * 3, "en", "s", 0, 0, 0)], SCHEMA)
    assert quality_rules.quality_rules(spark, empty).count() == 0
    assert quality_rules.quality_rules(spark, odd).count() == 1


def test_huffman_tokens(spark, docs, empty):
    encoder = Encoder(default_path())
    want, at = [], 0
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r in rows:
        ids = np.append(encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2).astype("<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = huffman_tokens.token_digests(spark, docs, huffman_tokens.Format(block_ids=500)).drop("ids").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert huffman_tokens.token_digests(spark, empty).count() == 0


def test_huffman_code():
    r = np.random.default_rng(2)
    for counts in (np.array([0, 5]), np.array([1, 1]), np.array([2**i for i in range(30)]), r.integers(0, 50, 3000), r.integers(1, 9, 70_000)):
        lengths = huffman_tokens.code_lengths(counts)
        assert (lengths > 0).tolist() == (counts > 0).tolist() and lengths.max() <= (16 if len(counts) < 65_536 else 18)
        assert sum(2.0 ** -lengths[lengths > 0]) <= 1
        ids = r.choice(np.flatnonzero(counts), 1000)
        payload, checkpoints = huffman_tokens.encode_ids(ids, huffman_tokens.canonical_codes(lengths), lengths)
        assert huffman_tokens.decode_ids([(payload, checkpoints, len(ids))] * 2, huffman_tokens.decode_table(lengths))[1].tolist() == ids.tolist()


def test_packing(spark, docs, empty):
    pieces = packing.pack_documents(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"]))[0].collect()
    encoder = Encoder(default_path())
    texts = {r[0]: r[1] or "" for r in corpus()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc_id, own in by_doc.items():
        ids, at = np.append(encoder.tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0).astype("<u4"), 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + p["length"]].tobytes()))
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(spark, empty)[0].count() == 0


def test_packing_solution_is_exact_and_tight():
    r = np.random.default_rng(3)
    p = packing.Packing(capacity=256, quantum=1)
    sizes = np.arange(1, 129)  # rests are half a sequence at most, so tokens alone bound the sequences closely
    demand = r.integers(1, 60, 128)
    patterns = packing.solve(sizes, demand, p)
    assert sum(n * x for n, x in patterns).tolist() == demand.tolist()
    assert all((x * sizes).sum() <= 256 for _, x in patterns)
    assert sum(n for n, _ in patterns) <= 1.01 * (demand * sizes).sum() / 256 + 2


def test_language_id(spark, docs, empty):
    rows = [(i, " ".join(f"{w}{'ung' if i % 2 else 'eau'}" for w in words(20, i)), ("de", "fr")[1 - i % 2], "s", 0, 0, 0) for i in range(300)]
    rows += [(1000, None, "fr", "s", 0, 0, 0), (1001, "123 !!", "fr", "s", 0, 0, 0), (1002, "", None, "s", 0, 0, 0), (None, "raeau", None, "s", 0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in language_id.identify_language(spark, df).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(300) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None]["lang_pred"] == "fr"
    assert language_id.identify_language(spark, empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_language(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_classifier(spark, empty):
    rows = [(i, " ".join(w.upper() + "!!" if i % 3 == 0 else w for w in words(80, i)), "en", "s", 0, 0, 0) for i in range(240)] + [(900, None, "en", "s", 0, 0, 0), (901, "", "en", "s", 0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(0, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify_quality(spark, df, labels).collect()}
    held = [i for i in range(240) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(240))
    assert sum(got[i]["predicted"] == int(i % 3 != 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows)
    assert quality_classifier.classify_quality(spark, empty, labels).count() == 0
    assert {r["score"] for r in quality_classifier.classify_quality(spark, df, labels.limit(0)).collect()} == {0.5}


def test_lm_scoring(spark, docs, empty):
    rows = [r for r in corpus() if r[0] is not None]
    got = lm_scoring.score_documents(spark, docs.where("doc_id is not null"), lm_scoring.Scoring(share=1, least_steps=30, rounds=1)).collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update([*tokens(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        w = [*tokens(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0
    assert len(got) == len(rows)
    assert lm_scoring.score_documents(spark, empty).count() == 0


def test_attention_model():
    """The gradient agrees with differences, leaves sum to one, training helps, each token is scored once."""
    tree = subword_lm.huffman_tree(np.array([5, 3, 0, 2, 1, 7]))
    p = {k: v.astype(np.float64) for k, v in subword_lm.start(tree).items()}
    text = np.array([0, 1, 2, 3, 4, 0, 1, 2, 0, 1, 2, 3, 3, 3, 1, 0, 2, 2, 1, 4])
    x, y, s = subword_lm.windows(text, tree.leaves)
    assert y[s].tolist() == text.tolist()
    loss, g = subword_lm.gradient(p, tree, x, y, s)
    for name in p:
        at = tuple(n // 2 for n in p[name].shape)
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += 1e-5
        assert (subword_lm.gradient(q, tree, x, y, s)[0] - loss) / 1e-5 == pytest.approx(g[name][at], abs=1e-3)
    hidden = np.random.default_rng(0).standard_normal((1, subword_lm.DIM))
    leaves = np.arange(tree.leaves)
    lp = subword_lm.log_probabilities(p, tree, np.repeat(hidden, len(leaves), 0), leaves)
    assert np.exp(lp + np.log(np.where(leaves == tree.leaves - 1, tree.others, 1))).sum() == pytest.approx(1)
    trained, _ = subword_lm.train(subword_lm.start(tree), tree, [text] * 20, 100)
    assert subword_lm.score(trained, tree, [text]).sum() > subword_lm.score(subword_lm.start(tree), tree, [text]).sum()


def test_chat_format(spark):
    turns = [(1, 0, "system", "be </s> kind"), (1, 1, "user", "[INST] \\e <|im_end|>\n"), (1, 2, "assistant", "ok\n<|im_start|>user\n"), (1, 3, "user", None), (2, 0, "assistant", "first"), (3, 0, None, ""), (3, 0, None, ""), (None, 5, "us\ner\\n", "x"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, None, "user", "q" * 70_000)]
    df = spark.createDataFrame([(*t, "y") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.parse_formatted(chat_format.format_conversations(df)).collect()}
    talks = defaultdict(list)
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        talks[conv].append((role or "", text or ""))
    for conv, said in talks.items():
        assert [tuple(t) for t in got[conv]["turns"]] == said
        assert got[conv]["learned_text"] == "".join(t for r, t in said if r == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
        assert got[conv]["formatted"].count("<|im_end|>") == len(said) and "</s>" not in got[conv]["formatted"]
    assert [got[k]["valid"] for k in (1, 2, 3, 4)] == [False] * 4 and got[1]["states"][:3] == ["system", "user", "assistant"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, data).collect()))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "decontaminate", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_rules.quality_rules(spark, docs).where("kept").collect()}
    first = brute_components([(i, rows[i]["text"]) for i in sorted(kept)])
    kept = sorted(i for i in kept if first[i] == i)
    texts, covered = brute_cut([(i, rows[i]["text"]) for i in kept], 400)
    cut = [(i, bytes(np.frombuffer(t, np.uint8)[~c]).decode("utf-8", "ignore")) for i, t, c in zip(kept, texts, covered)]
    left = spark.createDataFrame(cut, "doc_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.find_items(spark, left, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    encoder, tokens_of = Encoder(default_path()), {}
    for i, t in cut:
        if i not in bad:
            tokens_of[i] = len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1
    packed = defaultdict(int)
    for doc_id, _, length, _, total, *_ in got:
        assert total == tokens_of[doc_id]
        packed[doc_id] += length
    assert packed == tokens_of
