import hashlib

import numpy as np
import pytest

from tabweave.llm import vector_codes as v


def plain(rows, parts, entries, rounds, scale=4096):
    """Lloyd rounds over Python integers; rows: id, vector, label."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    xs = [[int(np.floor(scale * float(c))) for c in r[1]] for r in rows]
    width = len(xs[0]) // parts
    cut = [[x[p * width : (p + 1) * width] for x in xs] for p in range(parts)]
    books = [[list(q) for q in c[:entries]] for c in cut]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(q, books[p])[1] for q in cut[p]]
            for k in range(len(books[p])):
                mine = [q for q, a in zip(cut[p], at, strict=True) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(rows))]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    return sorted(
        (str(r[0]), "".join(f"{k:02x}" for _, k in f), e, sum(x for x, s in zip(errors, rows, strict=True) if s[2] == r[2]), digest) for r, f, e in zip(rows, found, errors, strict=True)
    )


def found(spark, rows, parts=2, entries=6, rounds=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, upper int").repartition(3)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in v.report(v.compress(df, parts=parts, entries=entries, rounds=rounds)).collect())


@pytest.mark.parametrize("spread", [1.0, 0.0005])  # the latter: integers from -2 to 2, most distances tie
def test_against_plain_lloyd(spark, spread):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, spread, 6) + 3 * spread * (i % 5)).tolist(), [None, 1, 2][i % 3]) for i in range(300)]
    assert found(spark, rows) == plain(rows, 2, 6, 4)


def test_copies_few_rows_and_rows_without_id(spark):
    same = [(i, [0.5, -0.5, 0.25, 0.0], 1) for i in range(40)] + [(50, [0.1, 0.2, 0.3, 0.4], None), (None, [0.5, 0.2, 0.3, 0.4], 1)]
    assert found(spark, same) == plain(same, 2, 6, 4)  # entries that are equal: the lower index wins, others stay unused
    assert found(spark, same[-2:]) == plain(same[-2:], 2, 6, 4)


def test_rows_that_take_no_part(spark):
    nan = float("nan")
    bad = [(1, None, 1), (2, [nan, 0.0], 1), (3, [None, 0.0], 1), (4, [float("inf"), 0.0], 1), (5, [1.0], 1), (6, [], 1)]
    good = [(0, [0.1, 0.2], 1), (7, [0.0, 0.0], 1)]
    assert found(spark, bad + good) == plain(good, 2, 6, 4)
    assert found(spark, bad[:1]) == []
    with pytest.raises(ValueError):
        found(spark, good, parts=3)
    with pytest.raises(Exception, match="beyond"):
        found(spark, [(0, [1e30, 0.0], 1), (1, [0.0, 0.0], 1)], entries=1)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (16, 8))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.3, 8)).tolist(), 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = v.compress(df, parts=1, entries=16, rounds=5)
    assert max(got.distances) < 2000 * 16 / 4  # a plain round takes 32,000
    codes = np.array([list(r.code) for r in got.rows.orderBy("vec_id").collect()])
    x = np.floor(4096 * np.array([r[1] for r in rows]))
    assert ((v.decoded(codes, got.codebooks) - x) ** 2).sum() < 0.05 * (x**2).sum()
