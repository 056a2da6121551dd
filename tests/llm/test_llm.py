"""The corpus operators against brute force, exact round trips and held-out accuracy; and the edge cases that their docstrings state."""

import base64
import heapq
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veridelta.llm import binary, bpe, exact_dedup, jaccard, language, mixing, neighbours, sharding, suffix, toxicity
from veridelta.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ("digest", "_digest", "key", "group", "tokens", "copies", "rate", "language", "score", "ids", "place", "n")
LONG = "lorem ipsum dolor " * 20_000


def table(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], KINDS)
    return df.withColumns({c: F.lit(7) for c in CLASH}) if clash else df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    rows = [(1, None, "en", "a"), (None, "one two three four", None, None), (2, "", "en", "a"), (3, "", None, "b"), (4, " \n\t ", "fr", "a"), (5, LONG, "en", "b"), (6, LONG, "en", None), (7, "one two three four", "en", "a"), (7, "one two three four", "en", "a"), (8, "x", "fr", "a"), (9, "!!!", "de", "a"), (None, None, None, None)]
    return table(spark, rows, True)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [], True)


# Exact dedup


@pytest.mark.parametrize("bits", [1, 8])
def test_cuckoo_filter(bits):
    r = np.random.default_rng(1)
    f, live = exact_dedup.CuckooFilter(bits=bits), set()
    for step in range(60):
        d = np.unique(r.integers(0, 2**64 if step % 3 else 3000, r.integers(0, 2000), np.uint64))
        if live and step % 4 == 3:
            d = np.unique(np.concatenate([d[:50], r.permutation(np.array(sorted(live), np.uint64))[: r.integers(0, 4000)]]))
            assert f.delete(d).tolist() == [x in live for x in d.tolist()]
            live -= set(d.tolist())
        else:
            assert f.insert(d).tolist() == [x not in live for x in d.tolist()]
            live |= set(d.tolist())
        assert len(f) == len(live) == (f.prints > 0).sum()
        assert f.seems(np.array(sorted(live), np.uint64)).all() and f.contains(d).tolist() == [x in live for x in d.tolist()]
    assert f.seems(r.integers(0, 2**64, 100_000, np.uint64)).mean() < 1e-3


def test_index_of_live_digests(spark, odd, none):
    kinds = "doc_id long, text string"
    df = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], kinds)
    index = exact_dedup.build_index(df(*[f"text {i}" for i in range(3000)], None, ""), parts=4)
    index = exact_dedup.insert(exact_dedup.delete(index, df("text 7", "text 7", "never", None)), df("new", "text 8", LONG))
    out, known = exact_dedup.contains(index, df("text 7", "text 8", "new", "never", None, "", LONG))
    assert [r[known] for r in sorted(out.collect())] == [False, True, True, False, False, True, True]
    out, known = exact_dedup.contains(exact_dedup.build_index(none), odd)
    assert not any(r[known] for r in out.collect()) and out.columns[:-1] == odd.columns


def test_colliding_digests_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "repeated_digests", lambda df, text: df.select(F.xxhash64(text).alias("digest")).distinct())
    assert {r.doc_id for r in exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")).collect()} == {1, 2}


def test_exact_dedup(spark, docs):
    want = {}
    for r in docs.collect():
        want.setdefault(r.text, []).append(r.doc_id)
    got = {(r.doc_id, r.copy_of) for r in exact_dedup.copies(docs).collect()}
    assert got == {(i, min(v)) for v in want.values() for i in v if i != min(v)} and got
    assert {r.doc_id for r in exact_dedup.exact_dedup(docs).collect()} == {min(v) for v in want.values()}


def test_exact_dedup_edges(odd, none):
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, None, 2, 4, 5, 7, 8, 9])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.copies(none).count() == 0
    assert Counter(tuple(r) for r in exact_dedup.copies(odd).collect()) == Counter([(3, 2), (6, 5), (7, 7), (None, 7)])


# N-gram Jaccard join


def grams(text, n=3):
    w = [x for x in re.split(r"[^a-z0-9'\x80-\U0010ffff]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_pairs(rows, t=0.5):
    sets = [(i, grams(x)) for i, x in rows if i is not None and x is not None]
    return {(min(a, b), max(a, b)): len(x & y) / len(x | y) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a != b and x and y and len(x & y) / len(x | y) >= t}


def near_rows(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(r.choice((1, 2, 5, 60, 300)))]
        out.append((i, " ".join(w)))
    return out


def brute_classes(rows, t=0.5):
    """{(id, set): (class id, links)} by comparing all with all."""
    nodes = sorted({(i, frozenset(grams(x))) for i, x in rows if x is not None and grams(x)}, key=lambda v: (v[0] is None, v[0] or 0))
    links, root = Counter(), list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, x) in enumerate(nodes):
        for m, (_, y) in enumerate(nodes[:k]):
            if len(x & y) / len(x | y) >= t:
                links.update((k, m))
                p, q = find(k), find(m)
                root[max(p, q)] = min(p, q)
    return Counter((i, nodes[find(k)][0], links[k]) for k, (i, _) in enumerate(nodes))


def classes(df):
    return Counter((r.doc_id, r.class_id, r.links) for r in jaccard.jaccard_classes(df).collect())


def uneven_rows(seed, n=90):
    """Sets of unequal size that overlap from below the threshold to equality, with copies, a hot passage, and pairs just at the threshold."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(r.choice((60, 4000)))]
    hot = [r.choice(words) for _ in range(40)]
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.6:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(0, 1 + len(w) // 5)):
                at = r.randrange(len(w)) if w else 0
                w[at : at + r.choice((0, 1, 1, 30))] = [r.choice(words)]
        elif kind < 0.7:
            w = hot + [r.choice(words) for _ in range(r.choice((3, 20, 40, 80)))]
        elif kind < 0.75:
            w = [f"at{i // 2}x{k}" for k in range(10)] + [f"half{i}x{k}" for k in range(r.choice((4, 5)))]
        else:
            w = [r.choice(words) for _ in range(r.choice((1, 2, 5, 60, 300)))]
        out.append((r.choice((i, i, i, i // 2, None)), " ".join(w)))
    return out


@pytest.mark.parametrize("seed", range(10))
def test_jaccard_classes(spark, seed, monkeypatch):
    if seed % 2:  # several batches, blocks and tasks
        monkeypatch.setattr(jaccard, "BATCH", 2000)
        monkeypatch.setattr(jaccard, "RANGE", 500)
        monkeypatch.setattr(jaccard, "BLOCK", 3)
        monkeypatch.setattr(jaccard, "HELD", 20)
    rows = uneven_rows(seed)
    assert classes(table(spark, [(i, t, "en", "a") for i, t in rows]).repartition(5)) == brute_classes(rows)


def test_jaccard_classes_of_documents(docs):
    assert classes(docs) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("threshold", (0.25, 0.5, 0.8))
def test_classes_at_other_thresholds(spark, threshold):
    rows = [(i, t) for i, (_, t) in enumerate(uneven_rows(7))]
    pairs = brute_pairs(rows, threshold)
    links = Counter(x for p in pairs for x in p)
    got = jaccard.jaccard_classes(table(spark, [(i, t, "en", "a") for i, t in rows]).repartition(5), threshold=threshold).collect()
    cls = {r.doc_id: r.class_id for r in got}
    assert {r.doc_id: r.links for r in got} == {i: links[i] for i, t in rows if grams(t)} and all(cls[a] == cls[b] for a, b in pairs)


def test_groups_do_not_gather_what_shares_a_frequent_token(spark):
    """All texts share frequent n-grams and none is near another, so hardly any two may meet in a group; sets of a group differ in size by less than a class."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    rows = [(i, " ".join(r.choices(words, weights, k=r.choice((200, 400, 800))))) for i in range(300)]
    sets = jaccard.token_sets(table(spark, [(i, t, "en", "a") for i, t in rows]), 3, 0.5).where("toks IS NOT NULL").collect()
    by = {}
    for s in sets:
        by.setdefault(s.grp, []).append(s.n)
    assert len(sets) > 250 and sum(len(v) * (len(v) - 1) // 2 for v in by.values()) < len(sets)
    assert all(max(v) <= min(v) * 2**0.25 + 1e-6 for v in by.values())


def test_similar_sizes_are_few_classes_apart():
    n = np.arange(1, 3000)
    kind = jaccard.size_class(n)
    for t in (0.2, 0.5, 0.7, 0.8):
        high = np.minimum(np.floor(n / t + 1e-9).astype(int), n[-1])
        assert (jaccard.size_class(high) - kind <= jaccard.classes_up(t)).all()
    assert jaccard.size_class(np.array([2**31 - 1]))[0] <= jaccard.CLASS


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(25)]
    assert classes(table(spark, [(i, t, "en", "a") for i, t in rows])) == Counter((i, 0, 24) for i in range(25))


def test_groups_that_cannot_reach_the_threshold_stay_closed():
    a, b = [np.arange(10, dtype=np.uint64), np.arange(6, 16, dtype=np.uint64)], [np.arange(4, 14, dtype=np.uint64), np.arange(0, 3, dtype=np.uint64)]
    n = np.array([10, 10])
    assert jaccard.opened(a, n, b, n, 0.5).tolist() == [True, True] and jaccard.opened(a[:1], n[:1], b[1:], n[:1], 0.5).tolist() == [False]


def test_packed_numbers():
    r = np.random.default_rng(0)
    for n, most in ((0, 9), (1, 9), (300, 2**56), (300, 40), (5, 2**63)):
        x = np.sort(r.integers(0, most, n)).astype(np.uint64)
        assert jaccard.unpack(jaccard.pack(x)).tolist() == x.tolist()


def test_overlaps_agree():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 400, 150)).astype(np.uint64) for _ in range(60)]
    pairs = np.array([(a, b) for b in range(60) for a in range(b)])
    many = jaccard.overlaps(np.tile(pairs, (40, 1)), sets)[: len(pairs)]
    assert many.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]


def test_jaccard_edges(spark, odd, none):
    assert classes(odd) == brute_classes([(r.doc_id, r.text) for r in odd.collect()]) == Counter([(5, 5, 1), (6, 5, 1), (7, 7, 1), (None, 7, 1), (8, 8, 0)])
    assert classes(none) == Counter() and jaccard.dedup_near(none).count() == 0
    kept = jaccard.dedup_near(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9, None])


def test_one_of_each_group_stays(spark):
    rows = near_rows(5)
    want, root = brute_pairs(rows), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.doc_id for r in jaccard.dedup_near(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == {find(i) for i in root}


@pytest.mark.parametrize("seed", range(6))
def test_kept_of_uneven_rows(spark, seed, monkeypatch):
    """Against brute force, with classes that leaders find in part, and with several blocks, slices and tasks."""
    if seed % 2:
        monkeypatch.setattr(jaccard, "BATCH", 2000)
        monkeypatch.setattr(jaccard, "RANGE", 500)
        monkeypatch.setattr(jaccard, "BLOCK", 3)
        monkeypatch.setattr(jaccard, "HELD", 20)
    rows = [(i, t) for i, (_, t) in enumerate(uneven_rows(seed))]
    want = {c for _, c, _ in brute_classes(rows)} | {i for i, t in rows if not grams(t)}
    assert Counter(r.doc_id for r in jaccard.dedup_near(table(spark, [(i, t, "en", "a") for i, t in rows]).repartition(5)).collect()) == Counter(want)


def test_a_class_of_near_copies_is_not_compared_with_itself(spark, monkeypatch):
    """Copies of one text, each with other words changed, are in many groups; to find the class, pairs of groups must not grow as the square of them."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(250)]
    rows = [(i, " ".join(r.choice(words[:40]) if r.random() < 0.05 else w for w in base)) for i in range(400)]
    met, real = [], jaccard.table

    def spy(df, name):
        out = real(df, name)
        if name == "jaccard-parts":
            met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "table", spy)
    got = {x.doc_id for x in jaccard.dedup_near(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == {c for _, c, _ in brute_classes(rows)} and sum(met) < len(rows)


def test_leaders_find_similar_sets_only():
    r = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, 80, False), r.integers(1000, 9000, k).astype(np.uint64)])) for k in (0, 10, 40, 90, 5, 0)] + [np.arange(2000, 2100, dtype=np.uint64)] * 2
    n = np.array([len(x) for x in sets])
    similar = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.5
    got = jaccard.led(sets, n, 0.5).tolist()
    assert all(similar(i, j) for i, j in got) and [7, 6] in got and {i for i, j in got if j == 0} == {i for i in range(1, 8) if similar(i, 0)}


def test_few_sets_are_looked_up():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200))).astype(np.uint64) for _ in range(40)]
    n = np.array([len(x) for x in sets])
    a, b = np.arange(10), np.arange(10, 40)
    index = jaccard.inverted([sets[i] for i in b])
    for i in a:
        assert jaccard.overlaps_with(sets[i], *index[1:], len(b)).tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in b]
    assert sorted(jaccard.compare(a, b, sets, n, 0.3, index).tolist()) == sorted(jaccard.compare(a, b, sets, n, 0.3).tolist()) != []


def test_components_of_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in jaccard.components(e).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# Toxicity


def brute_segments(x):
    """All maximal segments by their definition: the best segment, then the same left and right of it."""
    best = max(((sum(x[a:b]), -a, -b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a, b = -best[1], -best[2]
    return brute_segments(x[:a]) + [(a, b, best[0])] + [(b + i, b + j, s) for i, j, s in brute_segments(x[b:])]


def test_segments():
    r = random.Random(0)
    for _ in range(300):
        x = [r.choice((-3.1, -1.03, -0.51, 1.007, 2.2, 4.013)) for _ in range(r.randint(0, 14))]
        got = toxicity.segments(np.array(x))
        want = brute_segments(x)
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_log_odds_prefer_the_frequent_word():
    odds, z = toxicity.log_odds(np.array([40.0, 3.0, 100.0, 0.0, 0.0]), np.array([0.0, 0.0, 1000.0, 0.0, 60.0]))
    assert z[0] > z[1] > 0 and odds[2] < odds[0] and odds[3] == 0 and odds[4] < 0 and z[4] < -1


def test_weights_by_hand():
    t, c = np.array([6.0, 2.0]), np.array([1.0, 11.0])
    m = toxicity.fit(np.array([7, 5], np.uint64), t, c)
    prior = [toxicity.PRIOR * 7, toxicity.PRIOR * 13]
    want = []
    for i in (1, 0):
        a, b = t[i] + prior[i], c[i] + prior[i]
        odds = np.log(a / (8 + sum(prior))) - np.log(b / (12 + sum(prior)))
        want.append(odds * min(1, odds**2 / (1 / a + 1 / b) / toxicity.FULL_Z**2))
    assert m.words.tolist() == [5, 7] and m.weights == pytest.approx(want) and want[0] < 0 < want[1]
    share = (c + toxicity.PRIOR * (t + c)) / (12 + toxicity.PRIOR * 20)
    assert share @ (m.weights[::-1] - m.drift) <= toxicity.MARGIN + 1e-12 and share @ np.exp(m.scale * (m.weights[::-1] - m.drift)) == pytest.approx(1)
    assert toxicity.highest(m.score(np.array([7, 5, 7, 99], np.uint64))) == pytest.approx(max(m.weights[1] - m.drift, 2 * m.weights[1] + m.weights[0] - 3 * m.drift))


def test_passages_by_brute_force(spark):
    """Documents, p-values and passages of a model against all segments of each text, one by one."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = {}
    for r in docs.collect():
        raw = r.text.lower().encode()
        h, _ = toxicity.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), toxicity.WORD)
        tests = [m for m in (model, model.by.get(r.lang)) if m is not None]
        found = []
        for m in tests:
            at = {int(w): float(x) for w, x in zip(m.words, m.weights)}
            seen = Counter()
            x = np.array([at.get(int(w), 0.0) / (seen.update((int(w),)) or seen[int(w)]) ** 0.5 - m.drift for w in h])
            total = np.concatenate([[0], np.cumsum(x)])
            best = max((total[j] - total[: j + 1].min() for j in range(len(total))), default=0)
            found.append(min(1, len(tests) * (1 - np.exp(-m.k * len(h) * np.exp(-m.scale * best)))))
        if min(found) <= toxicity.ALPHA:
            want[r.doc_id] = min(found)
    got = {r.doc_id: r for r in toxicity.passages(docs, model).collect()}
    assert set(got) == set(want) and want
    for i, r in got.items():
        assert r.p_value == pytest.approx(want[i], rel=1e-6, abs=1e-12) and min(p.p_value for p in r.passages) == pytest.approx(r.p_value) and all(p.first < p.end for p in r.passages)


def test_scale():
    v, w = np.array([1.0, -1.0]), np.array([0.25, 0.75])
    assert toxicity.scale_of(v, w) == pytest.approx(np.log(3), abs=1e-6)


def test_toxicity_held_out_in_each_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = {r.doc_id for r in toxicity.passages(docs, toxicity.train(docs, labels.where(half))).collect()}
    hits = defaultdict(list)
    for r in labels.where(~half).join(docs.select("doc_id", "lang"), "doc_id").collect():
        hits[r.lang, r.toxic].append(r.doc_id in found)
    share = {k: sum(v) / len(v) for k, v in hits.items()}
    assert share["en", 1] > 0.9 and share["de", 1] > 0.8 and share["fr", 1] > 0.8 and share["es", 1] > 0.5  # two dozen toxic documents of es to learn from
    assert all(share[x, 0] < 0.01 for x in ("en", "de", "fr", "es"))


def test_small_languages_have_equal_shares():
    assert toxicity.quotas({"a": 10, "b": 1000, "c": 500}, 210) == {"a": 10, "b": 100, "c": 100}
    assert toxicity.quotas({"a": 3, "b": 5}, 100) == {"a": 3, "b": 5} and sum(toxicity.quotas({"a": 70, "b": 80, "c": 90}, 100).values()) <= 100


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    assert toxicity.passages(odd, toxicity.train(odd, labels)).count() == 0
    assert toxicity.passages(none, toxicity.train(none, labels)).count() == 0
    assert len(toxicity.train(odd, labels.where("toxic = 1")).words) == 0
    bad = table(spark, [(i, f"plain words here {i} " * 5 + ("vile " * 15 if i < 40 else "kind "), "en", "a") for i in range(120)] + [(None, "vile " * 20, "en", "a"), (5, "Vile, " * 20, "en", "a")], True)
    y = spark.createDataFrame([(i, int(i < 40)) for i in range(120)], "doc_id long, toxic int")
    got = Counter(r.doc_id for r in toxicity.passages(bad, toxicity.train(bad, y)).collect())
    assert got == Counter([*range(40), 5, None])


# Byte-level BPE


ALPHABET = ["a", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "$", "　", "\x1c", "日", "😀", "b c", "don't", "\r\n", "\x85", "<|endoftext|>"]


def test_tree_equals_the_whole():
    r, c = random.Random(3), bpe.Codec(VOCABULARY)
    for _ in range(3000):
        t = "".join(r.choices(ALPHABET, k=r.randint(0, 40)))
        c.leaf = r.choice((1, 2, 3, 7))
        assert c.encode(t) == c.whole(t) and c.decode(c.encode(t)) == t


def merged(text):
    """Encoding by definition: the published pattern's pieces, each merged pair by pair in order of rank."""
    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    out = []
    for piece in regex.findall(bpe.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_tree_equals_merging_by_rank(docs):
    r, c = random.Random(5), bpe.Codec(VOCABULARY, 16)
    texts = ["".join(r.choices(ALPHABET, k=60)) for _ in range(15)] + [x.text[:400] for x in docs.limit(4).collect()] + ["nospaceatall" * 30]
    assert [c.encode(t) for t in texts] == [merged(t) for t in texts]


def test_tree_on_documents(docs):
    c = bpe.Codec(VOCABULARY, 64)
    for r in docs.limit(60).collect():
        assert c.encode(r.text) == c.whole(r.text)


def test_bpe_edges(odd, none):
    out, (ids, n, exact) = bpe.encode_column(odd, VOCABULARY)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    for r in rows:
        assert (r[ids], r[n], r[exact]) == (None, None, None) if r.text is None else r[exact] and len(r[ids]) == r[n]
    assert bpe.encode_column(none, VOCABULARY)[0].count() == 0


# Suffix arrays


def brute_repeats(rows, size=suffix.WORDS):
    at, rep, rem = defaultdict(list), defaultdict(set), defaultdict(set)
    for i, t in rows:
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
        for k in range(len(w) - size + 1):
            at[tuple(w[k : k + size])].append((i, k))
    for v in at.values():
        if len(v) > 1:
            for i, k in v:
                rep[i].update(range(k, k + size))
                if (i, k) != min(v):
                    rem[i].update(range(k, k + size))
    return rep, rem


def test_suffix_array_by_sorting():
    r = np.random.default_rng(0)
    for _ in range(800):
        s = r.integers(0, r.integers(1, 6), r.integers(0, 40))
        sa = suffix.suffix_array(s)
        assert sa == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        lcp = suffix.common_prefixes(s, sa)
        for a, b in zip(sa, sa[1:]):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert lcp[b] == k


@pytest.mark.parametrize("shard_words", [suffix.SHARD_WORDS, 300])  # the second makes every shared passage a hot one
def test_repeated_passages(spark, monkeypatch, shard_words):
    monkeypatch.setattr(suffix, "SHARD_WORDS", shard_words)
    r = random.Random(2)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    hot, other = words(70), words(120)
    rows = []
    for i in range(40):
        w = words(r.randint(5, 150))
        if r.random() < 0.5:
            p = r.choice((hot, other))
            a = r.randint(0, 20)
            w[r.randint(0, len(w)) : 0] = p[a : a + r.randint(40, 100)]
        rows.append((i, " ".join(w)))
    rows += [(40, rows[0][1]), (41, "x " * 300), (42, " ".join(words(49)))]
    rep, rem = brute_repeats(rows)
    got = {x.doc_id: x for x in suffix.repeated_passages(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    spans = lambda s: {k for x in s for k in range(x.first, x.end)}
    assert set(got) == set(rep)
    for i, x in got.items():
        assert spans(x.repeated) == rep[i] and spans(x.removable) == rem.get(i, set())


def test_repeats_edges(spark, odd, none):
    got = {r.doc_id: r for r in suffix.repeated_passages(odd).collect()}
    assert set(got) == {5, 6} and got[6].removable[0].end == 60_000
    assert suffix.repeated_passages(none).count() == 0
    twice = table(spark, [(1, "a b c d e " * 11, "en", "a")] * 2)
    assert suffix.repeated_passages(twice).count() == 1


# Binary output


def test_perfect_hash():
    for n in (0, 1, 2, 7, 3000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
        _, slot, _ = binary.build_index(keys)
        assert sorted(slot.tolist()) == list(range(len(keys)))


def test_keyed_access(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(binary, "SHARD_BYTES", 20_000)
    binary.write_shards(docs, VOCABULARY).write.parquet(f"{tmp_path}/shards")
    shards = spark.read.parquet(f"{tmp_path}/shards")
    rows, c = {r.shard: r.asDict() for r in shards.collect()}, bpe.Codec(VOCABULARY)
    assert 2 < len(rows) <= rows[min(rows)]["shards"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        assert [c.decode(g[0].tolist()) for g in (binary.find(i, x) for x in rows.values()) if g] == [t]
    assert not any(binary.find(10**9 + k, x) for k in range(500) for x in rows.values())
    got = binary.look_up(shards, [*texts, 10**9])
    assert {i: [c.decode(g.tolist()) for g in v] for i, v in got.items()} == {i: [t] for i, t in texts.items()} | {10**9: []}


def test_keyed_access_with_empty_shards_and_hot_keys(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(binary, "SHARD_BYTES", 50)
    df = table(spark, [(i, f"text number {i} " * 3, "en", "a") for i in range(12)] + [(5, f"hot {k}", "en", "a") for k in range(60)] + [(None, "no key at all", "en", "a")] * 200)
    binary.write_shards(df, VOCABULARY).write.parquet(f"{tmp_path}/shards")
    shards, c = spark.read.parquet(f"{tmp_path}/shards"), bpe.Codec(VOCABULARY)
    got = {i: Counter(c.decode(g.tolist()) for g in v) for i, v in binary.look_up(shards, list(range(13))).items()}
    assert got == {i: Counter([f"text number {i} " * 3, *([f"hot {k}" for k in range(60)] if i == 5 else [])]) for i in range(12)} | {12: Counter()}
    docs = {r.shard: r.n_docs for r in shards.select("shard", "n_docs").collect()}
    assert sum(docs.values()) == 272 and max(docs.values()) < 60  # neither the hot key nor rows without a key fill a shard


def test_binary_edges(odd, none):
    rows = [r.asDict() for r in binary.write_shards(odd, VOCABULARY).collect()]
    c = bpe.Codec(VOCABULARY)
    get = lambda k: [c.decode(g.tolist()) for r in rows for g in binary.find(k, r)]
    assert get(7) == ["one two three four"] * 2 and get(2) == [""] and get(1) == [""] and get(5) == [LONG]
    assert sum(r["n_docs"] for r in rows) == odd.count() and binary.write_shards(none, VOCABULARY).count() == 0


# Language ID


def test_kernel_by_sets():
    a, b = "abcab".encode(), "bcad é".encode()
    sets = [{x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)} for x in (a, b)]
    p = [language.presence(np.frombuffer(x, np.uint8)) for x in (a, b)]
    assert [len(x) for x in p] == [len(x) for x in sets]
    assert language.overlaps(p[:1], p[1:])[0, 0] == pytest.approx(len(sets[0] & sets[1]) / (len(sets[0]) * len(sets[1])) ** 0.5)


def test_collapsed_scores_are_the_nystroem_scores(docs):
    rows = language.sample(docs, F.col("lang"), 12)
    m = language.Model([t for _, t in rows], [k for k, _ in rows])
    assert {k: n for k, n in Counter(k for k, _ in rows).items()} == {k: 12 for k in m.languages}
    p = [language.presence(np.frombuffer(t.lower().encode(), np.uint8)) for _, t in rows]
    k = language.overlaps(p, p)
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-8 * value.max()
    phi = k @ (vector[:, keep] / np.sqrt(value[keep]))
    y = np.where(np.array([a for a, _ in rows])[:, None] == np.array(m.languages)[None], 1.0, -1.0)
    w = np.full(len(rows), 1 / len(rows))
    c, t = w @ phi, w @ y
    beta = np.linalg.solve(((phi - c) * w[:, None]).T @ (phi - c) + language.RIDGE / len(rows) * np.eye(phi.shape[1]), ((phi - c) * w[:, None]).T @ (y - t))
    raw = [x.lower().encode() for _, x in rows]
    got = m.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert np.abs(got - ((phi - c) @ beta + t)).max() < 1e-3


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out, (lang, _, ok) = language.identify(d.where(~half), language.train(d.where(half)))
    rows = out.collect()
    assert sum(r[lang] == r.lang for r in rows) / len(rows) > 0.98 and sum(r[ok] for r in rows) / len(rows) > 0.995


def test_language_edges(spark, docs, odd, none):
    out, (lang, score, ok) = language.identify(odd, language.train(docs))
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    for r in rows:
        assert r[ok] is False and r[lang] is None if r.text is None or not re.search(r"[a-z]", r.text) else r[lang] is not None
    assert language.identify(none, language.train(docs))[0].count() == 0
    out, (_, _, ok) = language.identify(odd, language.train(none))
    assert not any(r[ok] for r in out.collect())


def test_foreign_and_junk_texts_are_rejected(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = random.Random(0)
    bad = [
        "La mattina seguente il sindaco della città ha aperto le porte del museo e molti visitatori sono entrati per vedere le opere",
        "Następnego dnia rano burmistrz miasta otworzył drzwi muzeum i wielu zwiedzających weszło, aby zobaczyć dzieła sztuki",
        "Seuraavana aamuna kaupungin pormestari avasi museon ovet ja monet vierailijat tulivat katsomaan taideteoksia",
        "Ertesi sabah belediye başkanı müzenin kapılarını açtı ve birçok ziyaretçi eserleri görmek için içeri girdi",
        "На следующее утро мэр города открыл двери музея и многие посетители вошли чтобы увидеть произведения искусства",
        "第二天早上市长打开了博物馆的大门许多游客进来参观艺术作品",
        "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=300)),
        base64.b64encode(r.randbytes(300)).decode(),
        " ".join(f"x{r.randrange(10**9)}" for _ in range(40)),
    ]
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = language.train(d.where(half))
    out, (_, _, ok) = language.identify(table(spark, [(i, t, None, "a") for i, t in enumerate(bad)]), model)
    assert not [bad[r.doc_id] for r in out.collect() if r[ok]]
    out, (lang, _, ok) = language.identify(d.where(~half), model)
    share = out.groupBy("lang").agg(F.avg(F.col(ok).cast("int")).alias("kept")).collect()
    assert len(share) == 4 and all(r.kept > 0.99 for r in share)


def test_few_documents_set_no_limits():
    m = language.limits(["the cat and the dog", "der Hund und die Katze"] * 3, ["en", "de"] * 3)
    assert np.isinf(m).all() and np.isinf(language.limits([], [])).all()


# Nearest neighbours


def test_neighbours_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {r.vec_id: r for r in neighbours.nearest(e).collect()}
    p = e.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    hit = 0
    for i, row in enumerate(d):
        true = ids[np.argsort(row)[:10]]
        hit += len(set(true) & set(got[ids[i]].neighbours))
        assert got[ids[i]].distances == sorted(got[ids[i]].distances) and ids[i] not in got[ids[i]].neighbours
    assert hit / (10 * len(ids)) >= 0.9


def test_deep_tree_and_query_set(spark, monkeypatch):
    """50,000 vectors make two levels; a third of them are copies of one, searched in chunks, and queries go in blocks."""
    monkeypatch.setattr(neighbours, "HELD", 4000)
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    r = np.random.default_rng(3)
    centre = r.normal(size=(300, 12))
    x = (centre[r.integers(0, 300, 50_000)] + 0.3 * r.normal(size=(50_000, 12))).astype(np.float32)
    x[r.permutation(50_000)[:17_000]] = x[0]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 12).cast(pa.list_(pa.float32()))}))
    built = []
    old = neighbours._level
    monkeypatch.setattr(neighbours, "_level", lambda *a: built.append(1) or old(*a))
    got = {q.vec_id: q for q in neighbours.nearest(df, queries=F.col("vec_id") % 50 == 0).collect()}
    assert len(built) == 2 and set(got) == set(range(0, 50_000, 50))
    hit = 0
    for i, q in got.items():
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, 40)[:40]
        near = np.flatnonzero(d <= d[near].max())
        want = near[np.lexsort((near, d[near]))][:10]
        hit += len(set(want.tolist()) & set(q.neighbours))
        assert q.distances == sorted(q.distances)
    assert hit / (10 * len(got)) >= neighbours.RECALL


def test_lower_ids_of_many_copies_are_nearest():
    r = np.random.default_rng(0)
    one = r.normal(size=8).astype(np.float32)
    v = np.concatenate([np.tile(one, (4000, 1)), one + r.normal(size=(1000, 8)).astype(np.float32) * np.float32(1e-4)])
    vid = r.permutation(len(v))
    q = [0, 1, 4000, 4001]
    d, ids = neighbours.best(v[q], vid[q], v, vid, 10)
    for j, i in enumerate(q):
        exact = ((v[i].astype(float) - v) ** 2).sum(1)
        exact[i] = np.inf
        want = np.lexsort((vid, exact))[:10]
        assert ids[j].tolist() == vid[want].tolist() and d[j].tolist() == exact[want].tolist()


def test_neighbours_edges(spark):
    v = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 0.0]), (8, [None, 1.0]), (None, [0.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("row", "v", "leaf", "part")})
    got = Counter((r.vec_id, tuple(r.neighbours)) for r in neighbours.nearest(df).collect())
    assert got == Counter({(1, (2, 9, 3)): 1, (2, (9, 1, 3)): 2, (3, (1, 2, 9)): 1, (9, (2, 1, 3)): 1, (4, ()): 1, (5, ()): 1, (6, ()): 1, (7, ()): 1, (8, ()): 1})
    assert neighbours.nearest(df.where("false")).count() == 0


# Sharding


def brute_lpt(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    out = []
    for s in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        out.append((s, k))
        heapq.heappush(heap, (load + s, k))
    return out


def test_lpt_runs():
    r = random.Random(0)
    for _ in range(200):
        k = r.randint(1, 6)
        sizes = [r.choice((1, 2, 3, 50, 51, 400)) for _ in range(r.randint(0, 200))]
        runs, loads = sharding.lpt_runs(list(Counter(sizes).items()), k)
        got = []
        for size, parts in runs:
            for j in range(Counter(sizes)[size]):
                first, turn = [p for p in parts if p[0] <= j][-1]
                got.append((size, turn[(j - first) % len(turn)]))
        assert got == brute_lpt(sizes, k)
        assert loads == [sum(s for s, x in got if x == j) for j in range(k)]


def test_sharding(docs):
    rows = sharding.shard(docs, 8).collect()
    texts, where, load = {r.doc_id: r.text for r in docs.collect()}, {}, Counter()
    for r in rows:
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
        load[r.shard] += len(texts[r.doc_id].encode())
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode())
    want = Counter()
    for s, k in brute_lpt(groups.values(), 8):
        want[k] += s
    assert len(rows) == docs.count() and load == want


def test_sharding_of_many_equal_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    df = table(spark, [(i, f"{i:05}", "en", "a") for i in range(300)] + [(i, None, "en", "a") for i in range(300, 320)] + [(None, "x" * 700, "en", "a")])
    load = Counter()
    rows = sharding.shard(df, 4).collect()
    for r in rows:
        load[r.shard] += r.group_size
    assert len(rows) == 321 and load == Counter([k for s, k in brute_lpt([5] * 300 + [700], 4) for _ in range(s)])


def test_sharding_edges(odd, none):
    rows = sharding.shard(odd, 3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert sharding.shard(none, 3).count() == 0


# Mixing


def test_mixing_meets_its_constraints(docs):
    source = {"src0": 0.2, "src1": 0.5, "src2": 0.3, "absent": 1.0}
    out, (tokens, rate, copies), got = mixing.rates(docs.where("source IN ('src0', 'src1', 'src2')"), source, None, 0.7)
    p = out.toPandas()
    mass = p[tokens] * p[rate]
    assert got["error"] < 1e-6 and mass.sum() == pytest.approx(p[tokens].sum(), rel=1e-5)
    for s, share in (("src0", 0.2), ("src1", 0.5), ("src2", 0.3)):
        assert mass[p.source == s].sum() / mass.sum() == pytest.approx(share, abs=1e-5)
    z = np.log1p(p[tokens])
    assert (mass * z).sum() / mass.sum() == pytest.approx((p[tokens] * z).sum() / p[tokens].sum(), rel=1e-5)
    assert set(np.abs(p[copies] - p[rate]) < 1) == {True}
    # Exponential tilt: log rates are linear in the constraints' features.
    known = p[p[tokens] > 0]
    x = np.column_stack([*[(known.source == s) for s in ("src0", "src1", "src2")], *[(known.lang == k) for k in sorted(set(known.lang))], np.log1p(known[tokens])]).astype(float)
    y = np.log(known[rate].to_numpy())
    assert np.abs(x @ np.linalg.lstsq(x, y, rcond=None)[0] - y).max() < 1e-6


def test_mixing_against_a_solver_of_its_own(docs, spark):
    """Iterative proportional fitting of shares, and bisection for the mean of z, find the same rates."""
    p = docs.toPandas()
    n = p.text.map(lambda t: len(re.findall(r"[^ \t\n\x0b\f\r]+", t))).to_numpy(float)
    z = np.log1p(n)
    z = (z - (n * z).sum() / n.sum()) / np.sqrt((n * z * z).sum() / n.sum() - ((n * z).sum() / n.sum()) ** 2)
    kinds = [np.unique(p[c], return_inverse=True)[1] for c in ("source", "lang")]
    want = []
    for k in kinds:
        share = np.bincount(k, n) ** 0.7
        want.append(share / share.sum())

    def fit(c):
        r = np.exp(c * z)
        for _ in range(400):
            for k, w in zip(kinds, want):
                r *= (w / (np.bincount(k, n * r) / n.sum()))[k]
        return r

    low, high = -3.0, 3.0
    for _ in range(50):
        c = (low + high) / 2
        low, high = (c, high) if (n * fit(c) * z).sum() < 0 else (low, c)
    out, (tokens, rate, copies), got = mixing.rates(docs)
    got = {r.doc_id: (r[tokens], r[rate]) for r in out.collect()}
    for i, t, r in zip(p.doc_id, n, fit(c)):
        assert got[i][0] == t and got[i][1] == pytest.approx(r, rel=1e-5)


def test_mixing_with_many_sources(spark):
    df = table(spark, [(i, "a " * (1 + i % 7), "en" if i % 3 else "fr", f"s{i % 5000}") for i in range(25_000)])
    out, (tokens, rate, _), got = mixing.rates(df)
    mass = out.groupBy("lang").agg(F.sum(F.col(tokens) * F.col(rate)).alias("m"), F.sum(tokens).alias("n")).collect()
    share = {r.lang: r.n**0.7 for r in mass}
    assert got["error"] < 1e-6 and all(r.m / sum(x.m for x in mass) == pytest.approx(share[r.lang] / sum(share.values()), abs=1e-5) for r in mass)


def test_mixing_edges(odd, none):
    out, names, got = mixing.rates(odd)
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0


# Pipeline


def test_stages(spark, docs):
    """Each stage on what its predecessor left, against brute force."""
    d = "/root/testdata/sf0.01"
    at, cols, kept = spark.read.parquet(f"{d}/documents.parquet"), None, []
    cols = at.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, at, d).cache()
        kept.append((at.collect(), new.collect()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == cols
            at = new
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    (a, b), (_, e), (_, j), (_, m), (_, t) = kept
    assert Counter(b) <= Counter(a) and len(b) >= 0.99 * len(a)  # clean documents stay
    low = {}
    for r in b:
        low[r.text] = min(r.doc_id, low.get(r.text, r.doc_id))
    assert Counter((r.doc_id, r.text) for r in e) == Counter((i, x) for x, i in low.items())
    first = {}
    for (i, cls, _), n in brute_classes([(r.doc_id, r.text) for r in e]).items():
        first.setdefault(cls, []).append(i)
    assert Counter(r.doc_id for r in j) == Counter(min(v) for v in first.values()) and len(j) < len(e)
    # Mixing: copies are the rates of a system that is solved by proportional fitting in test_mixing_against_a_solver_of_its_own; here their sums meet the shares.
    n = lambda x: len(re.findall(r"[^ \t\n\x0b\f\r]+", x))
    have, got = Counter(), Counter()
    for r in j:
        have[r.source] += n(r.text)
    for r in m:
        got[r.source] += n(r.text)
    want = {s: v**0.7 for s, v in have.items()}
    assert set(m) <= set(j) and all(got[s] / sum(got.values()) == pytest.approx(w / sum(want.values()), abs=0.02) for s, w in want.items())
    c = bpe.Codec(VOCABULARY)
    assert Counter((r.doc_id, c.decode(r.ids)) for r in t) == Counter((r.doc_id, r.text) for r in m) and all(r.exact for r in t)


def test_stages_on_odd_tables(spark, odd, none):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).collect()
