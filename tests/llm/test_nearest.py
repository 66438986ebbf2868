import numpy as np
from pyspark.sql import functions as F

from tabweave.llm import nearest


def exact(x, q, ids, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def run(spark, x, ids, **more):
    df = spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, rank int")
    out = {}
    for r in sorted(nearest.neighbours(df, F.col("vec_id") % 100 == 0, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_small_table_is_exact_with_ties(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 60, 0), rng.normal(size=(300, 16))])
    ids = rng.permutation(len(x))
    got = run(spark, x, ids)
    for q in np.flatnonzero(ids % 100 == 0):
        want = exact(x, q, ids, 10)
        assert [i for i, _ in got[ids[q]]] == [i for i, _ in want] and np.allclose([d for _, d in got[ids[q]]], [d for _, d in want])


def test_recall_on_noise(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SALT_ROWS", 300)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(6000)
    got = run(spark, x, ids)
    hits = sum(len({i for i, _ in exact(x, q, ids, 10)} & {i for i, _ in got[q]}) for q in range(0, 6000, 100))
    assert hits / 600 >= 0.9


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.5]), (200, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest.neighbours(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert nearest.neighbours(df.limit(0), F.lit(True)).count() == 0


def test_clustered_vectors_open_few_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 24)) * 8
    x = centres[rng.integers(0, 300, 12_000)] + rng.normal(size=(12_000, 24))
    forest = nearest.Forest.fit(x, 6)
    assert forest.share(x, 10) < 0.3
    noise = rng.normal(size=(3000, 64))
    assert nearest.Forest.fit(noise, 4).share(noise, 10) > 0.5


def test_repeated_ids_are_one_row(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.0, 2.0]), (2, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest.neighbours(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 0.1), (0, 2, 2, round(5**0.5, 6))]
