import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import hard_negatives as h


def plain(rows, low=80, high=100, positives=5, negatives=5, step=10):
    """All scores of all anchors; rows: id, label, integers."""
    out = []
    for i, label, x in rows:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, other == label) for j, other, y in rows if j != i)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fit = [r for r in scored if not r[2] and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, [v / 256 for v in x], label, 7, "r") for i, label, x in rows], "vec_id long, embedding array<double>, label int, score int, `list` string")
    return sorted(tuple(r) for r in h.mine(df.repartition(3), F.col("vec_id") % 10 == 0, **more).collect())


def table(n, width, spread, labels, seed):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), rng.normal(0, spread, width).astype(int).tolist()) for i in range(n)]


@pytest.mark.parametrize("anchors", [20_000, 7])
def test_against_all_scores(spark, monkeypatch, anchors):
    monkeypatch.setattr(h, "ANCHORS", anchors)  # several blocks
    monkeypatch.setattr(h, "ROWS", 64)
    rows = table(400, 8, 40, 4, 1)
    assert mined(spark, rows) == plain(rows)


def test_ties_copies_and_few_rows(spark):
    rows = table(60, 4, 2, 3, 2)  # small integers: most scores tie
    rows += [(60 + i, 1, rows[0][2]) for i in range(50)]  # copies of one vector, most with one label
    assert mined(spark, rows) == plain(rows)
    few = rows[:4]
    assert mined(spark, few) == plain(few)
    assert mined(spark, rows, low=50, high=120, positives=2, negatives=9) == plain(rows, 50, 120, 2, 9)


def test_rows_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [None, 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0], 2), (8, [1.0, 1.0], None), (None, [0.9, 0.0], 2), (9, [0.0, 0.0], 2), (11, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in h.mine(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 256 * 256, 230 * 256)]
    assert h.mine(df.limit(0), F.lit(True)).count() == 0
    assert h.mine(df, F.lit(False)).count() == 0
    named = df.withColumn("label", F.col("label").cast("string"))
    assert h.mine(named, F.col("vec_id") == 0).count() == 1
    with pytest.raises(ValueError):
        h.mine(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True))


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (2, [0.9], 2)], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in h.mine(df, F.col("vec_id") == 0).collect())
    assert got == sorted(2 * [(0, 1, 1, 2, 65536, 230 * 256), (0, 1, 2, 2, 65536, 230 * 256)])


def test_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 32, (4000, 64)).astype(np.int64)
    cells = h.Cells(x[:500], x.min(0), x.max(0))
    codes, anchors = cells.codes(x), x[:5]
    low, high = cells.tables(anchors)
    lower, upper, score = h.bounds(low, codes), h.bounds(high, codes), x @ anchors.T
    assert (lower <= score).all() and (score <= upper).all()

    class Rows:
        ids, labels, vectors = np.arange(4000), np.sort(rng.integers(0, 4, 4000)), x
        of = h._Rows.of

    rows = Rows()
    rows.codes = codes
    block = h.Block(np.arange(5), np.zeros(5, np.int64), anchors)
    best = h.Best(5, 5)
    assert h.positives_of(rows, block, cells, best) < 5 * 4000 / 20  # few rows are scored exactly
    assert len(best.list) == 25
