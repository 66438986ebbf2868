"""Scores and repairs of relations between columns: seeded random tables held against plain loops, and single rules by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabweave.operators import pairs, relations, repair

#: Kinds of random column pairs: parents, children, how closely a child fixes its parent, shares of missing parents and children.
KINDS = [(2, 3, 0.0, 0, 0), (4, 20, 0.9, 0, 0), (4, 20, 0.9, 0.2, 0.1), (9, 9, 1.0, 0, 0), (9, 9, 1.0, 0.15, 0.15), (1, 12, 0.5, 0.3, 0), (12, 1, 0.5, 0, 0.3), (30, 60, 0.97, 0.05, 0.05), (3, 5, 0.8, 0, 0), (5, 200, 0.2, 0.4, 0.4)]
ROWS = 240


def random_pairs():
    """(parent, child) of every row, for each kind."""
    rng, out = random.Random(20250), []
    for parents, children, close, no_parent, no_child in KINDS:
        rows = []
        for _ in range(ROWS):
            child = min(int(rng.expovariate(3 / children)), children - 1)
            parent = child % parents if rng.random() < close else rng.randrange(parents)
            rows.append((None if rng.random() < no_parent else f"p{parent}", None if rng.random() < no_child else f"c{child}"))
        out.append(rows)
    return out


RANDOM = random_pairs()
PAIRS = [(f"parent{k}", f"child{k}") for k in range(len(KINDS))]


@pytest.fixture(scope="module")
def wide(spark):
    names = ", ".join(f"{p} string, {c} string" for p, c in PAIRS)
    rows = [(i + 1, *(v for table in RANDOM for v in table[i])) for i in range(ROWS)]
    return spark.createDataFrame(rows, f"initial_id long, {names}").repartition(5).cache()


@pytest.fixture(scope="module")
def edges(wide):
    return pairs.directed(pairs.pair_counts(wide, PAIRS)).cache()


def parents_of(rows):
    out = {}
    for p, c in rows:
        out.setdefault(c, set())
        if p is not None:
            out[c].add(p)
    return out


def table(spark, rows, names="parent string, child string"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], f"initial_id long, {names}")


@pytest.mark.parametrize("drop", [True, False])
def test_one_to_many_against_a_loop(edges, drop):
    got = {(r.parent, r.child): r for r in pairs.one_to_many(edges, drop).collect()}
    for (a, b), rows in zip(PAIRS, RANDOM, strict=True):
        for parent, child, seen in ((a, b, rows), (b, a, [(c, p) for p, c in rows])):
            used = [r for r in seen if None not in r] if drop else seen
            known = parents_of(used)
            valid, r = sum(c is not None and len(known[c]) == 1 for _, c in used), got[parent, child]
            assert (r.valid, r.total) == (valid, len(used))
            assert r.percentage == pytest.approx(100 * valid / len(used)) and r.violation_ratio == pytest.approx(1 - valid / len(used))
            assert (r.distinct_parent, r.distinct_child) == tuple(len({x[k] for x in seen} - {None}) for k in (0, 1))
            assert (r.na_parent, r.na_child) == tuple(sum(x[k] is None for x in seen) for k in (0, 1))


@pytest.mark.parametrize("drop", [True, False])
def test_one_to_one_against_a_loop(wide, drop):
    got = {r.col1: r for r in pairs.one_to_one(pairs.pair_counts(wide, PAIRS), drop).collect()}
    for (a, _), rows in zip(PAIRS, RANDOM, strict=True):
        used = [r for r in rows if None not in r] if drop else rows
        ahead, back = parents_of([(c, p) for p, c in used]), parents_of(used)
        fits = [(p is None or len(ahead[p]) == 1, c is None or len(back[c]) == 1) for p, c in used]
        whole = [x and y and None not in r for (x, y), r in zip(fits, used, strict=True)]
        valid = len(used) if all(x and y for x, y in fits) else sum(whole)
        assert (got[a].valid, got[a].total) == (valid, len(used))
        assert (got[a].distinct1, got[a].distinct2) == tuple(len({x[k] for x in rows} - {None}) for k in (0, 1))


def test_one_to_one_of_exact_partners(spark):
    rows = [(f"k{i % 7}", f"v{i % 7}") for i in range(30)]
    one = lambda rows: pairs.one_to_one(pairs.pair_counts(table(spark, rows), [("parent", "child")]), drop_na=False).first()
    assert (one(rows).valid, one(rows).total) == (30, 30)
    # a missing value beside exact partners spoils nothing; a second partner spoils its value's rows and those with a missing value
    assert one([*rows, ("k3", None)]).valid == 31
    assert one([*rows, ("k3", None), ("k3", "v9")]).valid == 30 - sum(i % 7 == 3 for i in range(30))


@pytest.mark.parametrize("k", [1, 2, 5])
def test_row_masks_against_a_loop(wide, k):
    parent, child = PAIRS[k]
    known = parents_of(RANDOM[k])
    got = {r.initial_id: r.valid for r in pairs.row_mask(wide, parent, child).collect()}
    assert got == {i + 1: c is not None and len(known[c]) == 1 for i, (_, c) in enumerate(RANDOM[k])}


@pytest.mark.parametrize("drop", [True, False])
def test_correction_plans_against_a_loop(edges, drop):
    got = {}
    for r in repair.plans(edges, drop).collect():
        got.setdefault((r.parent, r.child), {})[r.cv] = (r.correct_value, r.parents, r.present, r.top, r.second, r.num_changes)
    for (a, b), rows in zip(PAIRS, RANDOM, strict=True):
        want = {}
        for value in {c for _, c in rows} - {None}:
            seen = [p for p, c in rows if c == value and not (drop and p is None)]
            counts = Counter(p for p in seen if p is not None)
            if len(counts) > 1:
                (best, top), (_, second) = sorted(counts.items(), key=lambda x: (-x[1], seen.index(x[0])))[:2]
                want[value] = (best, len(counts), sum(counts.values()), top, second, len(seen) - top)
        assert got.get((a, b), {}) == want


def test_plans_of_tables_without_violations(spark):
    for rows in ([], [("x", "1")], [("x", "1"), ("x", "2"), (None, "2")], [("x", None), ("y", None)]):
        assert repair.plan_for_pair(table(spark, rows), "parent", "child").count() == 0


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="missing columns"):
        repair.plan_for_pair(table(spark, []), "parent", "nothing")


def test_thresholds_compare_in_percent(spark):
    # shares whose product with 100 is not the whole number that was given
    odd = [t for t in range(1, 100) if (t / 100) * 100 != t]
    df = spark.createDataFrame([(t, (t / 100) * 100) for t in odd], "t int, percentage double")
    assert odd and all(pairs.above(df.filter(F.col("t") == t), t).count() == 1 for t in odd[:4])


def test_confidence_against_the_rule(spark):
    steps = {5: 80, 10: 75, 20: 70, 50: 65, 100: 60}
    needed = lambda n: next((p for least, p in sorted(steps.items(), reverse=True) if n >= least), 85)
    rng = random.Random(7)
    cases = [(t, s, rng.randrange(0, t // 2 + 1)) for t in (*range(1, 26), 49, 51, 99, 101, 250) for s in {0, t // 5, t // 3, t // 2}]
    df = spark.createDataFrame([(top + second + rest, top, second) for top, second, rest in cases], "n long, top long, second long")
    for least, ratio in ((5, 3.0), (1, 2.0), (12, 1.25)):
        got = df.select("n", "top", "second", repair.needed_percent(F.col("n")).alias("p"), repair.confident(F.col("n"), F.col("top"), F.col("second"), least, ratio).alias("sure")).collect()
        for r in got:
            assert r.p == needed(r.n)
            assert r.sure == (r.n >= least and r.top / r.n * 100 >= needed(r.n) and (r.second == 0 or r.top / r.second >= ratio))


def test_application_changes_the_planned_cells_only(wide, edges):
    parent, child = PAIRS[2]
    plan = repair.plan_for_pair(wide, parent, child)
    best = {r.cv: (r.correct_value, r.confident) for r in plan.collect()}
    assert {sure for _, sure in best.values()} == {True, False}
    for only in (False, True):
        cells = repair.cells(wide, plan, parent, child, confident_only=only)
        got = {r.initial_id: (r[parent], r[child]) for r in repair.apply(wide, cells).collect()}
        for i, (p, c) in enumerate(RANDOM[2], 1):
            value, sure = best.get(c, (p, False))
            assert got[i] == (value if p is not None and (sure or not only) else p, c)
    t = repair.totals(plan).first()
    assert (t.corrections, t.confident_corrections, t.unsure_corrections) == (len(best), sum(s for _, s in best.values()), sum(not s for _, s in best.values()))
    assert t.changes == t.confident_changes + t.unsure_changes == repair.cells(wide, plan, parent, child).count()


def test_the_later_plan_wins_a_cell(spark):
    df = table(spark, [("north", "7"), ("south", "8")])
    changes = spark.createDataFrame([(4, "parent", 2, "late"), (3, "parent", 2, "early"), (3, "child", 2, "9"), (5, "parent", 77, "gone")], "plan_order int, column string, initial_id long, new_value string")
    assert sorted((r.initial_id, r.parent, r.child) for r in repair.apply(df, changes).collect()) == [(1, "north", "7"), (2, "late", "9")]


def test_reduction_against_a_search_of_all_paths():
    rng = random.Random(11)

    def reaches(edges, start, end):
        seen, todo = set(), [start]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in seen:
                    seen.add(b)
                    todo.append(b)
                    break
            else:
                todo.pop()
        return end in seen

    for _ in range(20):
        names = "qrstuvw"
        dag = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(12)})
        want = {e for e in dag if not reaches([x for x in dag if x != e], *e)}
        assert set(relations.reduced(dag)) == want and set(relations.removed(dag)) == set(dag) - want
        for a, b in set(dag) - want:
            path = relations.shortest_path(sorted(want), a, b)
            assert path[0] == a and path[-1] == b and all(e in want for e in zip(path, path[1:], strict=False))
    ring = [("q", "r"), ("r", "s"), ("s", "t"), ("t", "q")]
    assert set(relations.reduced(ring)) == set(ring) and not relations.is_acyclic(ring)
    assert relations.reduced([("w", "q"), ("q", "w"), ("q", "s")]) == [("q", "s"), ("q", "w")]
    assert relations.shortest_path(ring[:2], "s", "q") is None
