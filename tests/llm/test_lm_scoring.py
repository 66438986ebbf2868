import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tabweave.llm import lm_scoring as L
from tabweave.llm.common import crc_mod

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["the cat sat on the mat", "abba" * 400 + " " + "baab" * 400, "The dog sat on  the log!", "", None, "a\tb\nc    x", "x" * 3000 + " the", "le chat est sur la table"] * 9 + ["le chien " * 40, "unseen wörds\x1c here"]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return {r.doc_id: r for r in L.score(df, crc_mod("doc_id", 7) == 2, PATH, **more).collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_base_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(L, "REPLICA", 64)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    got = run(spark, rows, head=head)
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    c = Counter(w for i, t, _ in rows if not out[i] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t, _ in rows:
        tokens = [*words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_no_training_texts_and_empty(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = run(spark, [(held, "a b", "x")])[held]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0
    assert not run(spark, [])


def model(seed=0):
    rng, ids = np.random.default_rng(seed), L.subwords(PATH).size + 1
    by_id = np.zeros(ids)
    by_id[rng.choice(ids, 600, replace=False)] = rng.integers(1, 90, 600)
    by_id[-1] = 5
    a = L.layout(by_id, L.subwords(PATH).names)
    w = {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in L.initial(a).items()}
    return L.Model(a, w), by_id


def test_probabilities_sum_to_one():
    m, _ = model()
    a, leaves = m.layout, len(m.layout.root)
    u, t, s = L.windows(np.array([3, 5, 8, 0]), np.array([0, 4]), a.end)
    logs = np.array([L.log_probabilities(L.Ready.of(m.weights), a, u, np.where(np.arange(L.WINDOW) == 2, k, t), s)[2] for k in range(leaves)])
    assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-3)
    # every id, seen or not, has its share of a leaf
    assert math.isclose(np.exp(logs[a.leaf].astype(float) + a.log_share).sum(), 1, rel_tol=1e-3)


def test_each_place_is_scored_once_and_sees_only_what_is_before():
    rng, (m, _) = np.random.default_rng(1), model()
    a, leaves = m.layout, len(m.layout.root)
    first = np.array([0, 1, 8, 8 + L.WINDOW, 300])
    c = rng.integers(0, leaves, 300)
    u, t, s = L.windows(c, first, a.end)
    assert np.array_equal(t[s], c)
    whole = L.log_probabilities(L.Ready.of(m.weights), a, u, t, s)
    changed = c.copy()
    changed[200:] = rng.integers(0, leaves, 100)
    assert np.allclose(whole[:200], L.log_probabilities(L.Ready.of(m.weights), a, *L.windows(changed, first, a.end))[:200], atol=1e-5)


def test_gradients():
    m, _ = model()
    rng, a = np.random.default_rng(2), m.layout
    u, t, s = L.windows(rng.integers(0, len(a.root), 60), np.array([0, 20, 60]), a.end)
    w = {k: x.astype(np.float64) for k, x in m.weights.items()}
    loss = lambda w: -L.log_probabilities(L.Ready.of(w), a, u, t, s).mean()
    g = L.gradients(w, a, u, t, s)
    kind = int(a.root[t[s]][a.root[t[s]] >= L.SINGLE][0]) - L.SINGLE
    for k in w:
        at = tuple(rng.integers(0, d) for d in w[k].shape)
        at = {"embed": (u[0, 0], 1), "shift": (u[0, 0], 2), "inner": (kind, 3, 0), "inner_bias": (kind, 0)}.get(k, at)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert math.isclose((loss(up) - loss(down)) / 2e-4, g[k][at], rel_tol=0.03, abs_tol=2e-4), k


def test_training_windows_hold_whole_beginnings_and_ends():
    s, rows = L.subwords(PATH), ["one two three", "", None, "word " * 500]

    class Rows:
        def mapInArrow(self, run, schema):
            return [x for b in run(iter([pa.RecordBatch.from_arrays([pa.array(rows)], names=["t"])])) for x in b.column(0).to_pylist()]

    got = np.concatenate([np.frombuffer(x, s.dtype).reshape(-1, L.WINDOW + 1) for x in L.training_windows(Rows(), PATH, 1)])
    blank = np.iinfo(s.dtype).max
    want = [s.size, *s.encoding.encode_ordinary(" one two three"), s.size]
    assert got[0].tolist() == want + [blank] * (L.WINDOW + 1 - len(want))
    assert got[1].tolist() == got[2].tolist() == [s.size, s.size] + [blank] * (L.WINDOW - 1)
    assert len(got) == 3 + 500 // L.BLOCK + 1 and (got[3:, 0] == s.size).sum() == 1 and s.size in got[-1]


def test_every_id_is_the_next_one_of_one_training_window():
    s, texts = L.subwords(PATH), [*TEXTS, "one " * 16, "some longer words " * 300]

    class Rows:
        def mapInArrow(self, run, schema):
            return [x for b in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])])) for x in b.column(0).to_pylist()]

    got = np.concatenate([np.frombuffer(x, s.dtype).reshape(-1, L.WINDOW + 1) for x in L.training_windows(Rows(), PATH)])
    blank, seen, pairs, rows = np.iinfo(s.dtype).max, Counter(), Counter(), 0
    for x in got.tolist():
        seen.update((a, b) for a, b in zip(x, x[1:]) if b != blank)
    for t in texts:
        ids = [s.size, *(x for w in words(t) for x in s.encoding.encode_ordinary(" " + w)), s.size]
        pairs.update(zip(ids, ids[1:]))
        rows += -(-(len(ids) - 1) // L.WINDOW)
    assert seen == pairs and len(got) == rows


def test_training_helps_on_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "REPLICA", 6000)
    rng = np.random.default_rng(3)
    lists = [["red", "blue", "green", "tea", "cup"], ["eins", "zwei", "drei", "vier"]]
    rows = [(i, " ".join(rng.choice(lists[i % 2], 60)), "x") for i in range(600)]
    got = run(spark, rows).values()
    held = [r for r in got if r.held_out]
    assert sum(r.attention_score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("head", [1 << 18, 0])
def test_texts_that_occur_elsewhere_are_likelier(spark, monkeypatch, head):
    monkeypatch.setattr(L, "REPLICA", 64)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)], 200)) for _ in range(40)]
    rows = [(i, t, "x") for i, t in enumerate([*texts, *texts[:10]])]
    got = run(spark, rows, head=head)
    twice, once = [*range(10), *range(40, 50)], range(10, 40)
    gain = {i: r.score - r.attention_score for i, r in got.items()}
    # a held-out text whose copy is held out too has no other
    seen = [i for i in twice if not (got[i % 40].held_out and got[i % 40 + 40].held_out) and (not got[i].held_out or not got[i % 40 + 40 if i < 40 else i % 40].held_out)]
    alone = [i for i in seen if not got[i].held_out and got[i % 40 + 40 if i < 40 else i % 40].held_out]
    assert len(seen) > 12 and all(gain[i] > 100 for i in seen if i not in alone)
    assert all(gain[i] < 1 for i in [*once, *alone])


def test_attention_learns_from_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "REPLICA", 64)
    learned, fit = [], L.fit
    monkeypatch.setattr(L, "fit", lambda texts, *more: learned.append(texts.count()) or fit(texts, *more))
    got = run(spark, [(i, t, "x") for i, t in enumerate(TEXTS)])
    assert learned == [sum(not r.held_out for r in got.values())]


def test_attention_learns_from_every_id_of_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "REPLICA", 4)
    made, windows, s = [], L.training_windows, L.subwords(PATH)
    monkeypatch.setattr(L, "training_windows", lambda *a: made.append(windows(*a)) or made[-1])
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, "one " * 16, "some longer words " * 300])]
    got = run(spark, rows)
    seen, blank = Counter(), np.iinfo(s.dtype).max
    for r in made[0].collect():
        for x in np.frombuffer(r.windows, s.dtype).reshape(-1, L.WINDOW + 1).tolist():
            seen.update((a, b) for a, b in zip(x, x[1:]) if b != blank)
    pairs = Counter()
    for i, t, _ in rows:
        if not got[i].held_out:
            ids = [s.size, *(x for w in words(t) for x in s.encoding.encode_ordinary(" " + w)), s.size]
            pairs.update(zip(ids, ids[1:]))
    assert not pairs - seen and not seen.keys() - pairs.keys()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the sample tables")
def test_held_out_documents_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in L.score(docs, crc_mod("doc_id", 7) == 2, PATH).collect() if r.held_out]
    words = sum(r.n_tokens for r in held)
    base, plain = (sum(r[c] for r in held) / words for c in ("base_score", "attention_score"))
    assert plain > base + 0.01


def test_arrays_of_a_step_reuse_their_memory():
    import resource

    from tabweave.llm.common import held, release

    held()
    step = lambda: sum(float(x[-1]) for x in [np.ones(400_000, np.float32) for _ in range(8)])
    step()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(50):
        step()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 5000  # mapped anew each time: 156,000 pages
    release()
