import random
import re

import numpy as np
import pytest

from tabweave.llm import components as C
from tabweave.llm import jaccard_join as J
from tabweave.llm.components import connected_components


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = label[x], label[y]
                for z in ids:
                    if label[z] in (a, b):
                        label[z] = min(a, b)
    return {i: (len(sets[i]), label[i]) for i in ids}


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for n in (1, 2, 3, 5, 8, 11, 12, 13, 20, 21, 30, 45, 80, 150, 400):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 12))):
                at = rng.randrange(len(copy)) if copy else 0
                rng.choice([lambda: copy.pop(at) if len(copy) > 1 else None, lambda: copy.insert(at, rng.choice(words)), lambda: copy.__setitem__(at, rng.choice(words)) if copy else None])()
            out.append(" ".join(copy))
        out.append(" ".join(base).upper())
    line = " ".join(words[:30])
    out += [line + " " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(20)] + ["", None, " \n", "a a a a a a a a", "a a a a"]
    return list(enumerate(out, 3))


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 90, 100, 600_000), (5, 80, 100, 600_000), (3, 80, 100, 300)])
def test_against_brute_force(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(J, "BLOCK_TOKENS", block)
    monkeypatch.setattr(J, "ONE_IN", 2)
    rows = texts(k + num)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(df, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_signatures_lose_no_pair():
    rng, plan = np.random.default_rng(1), J.Plan(80, 100)
    for _ in range(4000):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.25]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 4) + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            tokens = np.union1d(a, b)
            for common in (tokens[:0], tokens, tokens[rng.random(len(tokens)) < rng.random()]):
                assert len(np.intersect1d(J.signatures(a, plan, {}, common), J.signatures(b, plan, {}, common)))


def test_empty_and_null_ids(spark):
    assert J.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = J.components(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (4, "A b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (4, 1)]
    two = [(3, "a b c d e f"), (8, "u v w x y z"), (8, "a b c d e f"), (9, "u v w x y z"), (8, None)]
    got = J.components(spark.createDataFrame([(*r, 5) for r in two], "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 2, 3), (8, 0, 8), (8, 2, 3), (8, 2, 8), (9, 2, 8)]


def test_points_bound_the_overlap():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 400, int(rng.integers(1, 300))).astype(np.uint64) * J._SALT) for _ in range(2))
        p, q = J.point(a), J.point(b)
        least = min(len(p), len(q))
        assert p.sum() == len(a) and np.minimum(J.folded(p, least), J.folded(q, least)).sum() >= len(np.intersect1d(a, b))


def test_the_tree_rules_most_unlinked_pairs_out():
    rng, plan = np.random.default_rng(8), J.Plan(80, 100)
    sets = [np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(300)]
    points = np.stack([J.point(s, 128) for s in sets])
    tree = J.Tree(points, points.sum(1))
    left = sum(len(tree.near(q, np.arange(q + 1, 300), plan)) for q in range(299))
    assert left <= 5  # of 44,850


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_components_of_a_long_path(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "TASK_EDGES", limit)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(path).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def test_size_estimates_stay_small_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "TASK_EDGES", 3)
    rng = random.Random(4)
    names = rng.sample(range(1000), 400)
    path = [(a, b, rng.randrange(40)) for a, b in zip(names, names[1:], strict=False)]
    edges = spark.createDataFrame(path, "a long, b long, t int").repartition(8, "t").select("a", "b")
    out = connected_components(edges)
    assert {r.component for r in out.collect()} == {min(names)} and out.count() == 400
    bits = out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    assert bits < 50


def test_most_frequent_tokens_without_sorting_at_the_driver(spark):
    rng = random.Random(5)
    rows = [(t - 3000, c) for t, c in enumerate(rng.choice([2] * 50 + [3] * 9 + [4, 70, 1 << 20]) for _ in range(6000))]
    df = spark.createDataFrame(rows, "token long, count long").repartition(3)
    for most in (0, 10, 500, 2500, 6000, 9000):
        got = J.most_frequent(df, most).view(np.int64)
        assert sorted(got.view(np.uint64).tolist()) == got.view(np.uint64).tolist()
        by = dict(rows)
        least = min((by[t] for t in got.tolist()), default=1 << 30)
        above = {t for t, c in rows if c > least}
        assert above <= set(got.tolist())  # all of higher counts, and about as many as fit of the lowest
        assert len(got) == min(most, 6000) or abs(len(got) - most) < 0.1 * most + 30
    assert len(J.most_frequent(df.limit(0), 10)) == 0
    plans = []
    kept, J.durable = J.durable, lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or kept(d)
    try:
        J.components(spark.createDataFrame(list(enumerate(texts(3))), "doc_id long, text string")).count()
    finally:
        J.durable = kept
    assert plans and not any("TakeOrdered" in p for p in plans)
