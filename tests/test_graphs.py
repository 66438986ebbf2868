"""Reachability, reduction and paths as joins, against searches in plain Python and the graph of columns."""

import random
from itertools import product

import pytest

from tabweave.operators import graphs, relations


def frame(spark, edges):
    return spark.createDataFrame(sorted(set(edges)), "src string, dst string").repartition(3)


def pairs(df):
    return {(r.src, r.dst) for r in df.collect()}


def distances(edges):
    out = {}
    for start in {a for a, _ in edges}:
        level, k = {start}, 0
        seen = {}
        while level:
            k += 1
            level = {b for a, b in edges if a in level} - set(seen)
            seen.update(dict.fromkeys(level, k))
        out |= {(start, b): k for b, k in seen.items()}
    return out


RNG = random.Random(17)
NAMES = [f"n{i:02}" for i in range(14)]
DAG = {tuple(sorted(RNG.sample(NAMES, 2))) for _ in range(40)}
CYCLIC = {tuple(RNG.sample(NAMES, 2)) for _ in range(22)} | {("n01", "n01")}


@pytest.mark.parametrize("edges", [DAG, CYCLIC])
def test_closure_and_paths(spark, edges):
    want = distances(edges)
    df = frame(spark, edges)
    assert {(r.src, r.dst): r.steps for r in graphs.closure(df).collect()} == want
    some = spark.createDataFrame([("n02",), ("n05",)], "src string")
    assert {(r.src, r.dst): r.steps for r in graphs.closure(df, some, 2).collect()} == {k: v for k, v in want.items() if k[0] in ("n02", "n05") and v <= 2}
    wanted = frame(spark, [p for p in product(NAMES, NAMES) if RNG.random() < 0.4])
    got = {(r.src, r.dst): r.path for r in graphs.paths(df, wanted).collect()}
    assert got.keys() == pairs(wanted) & want.keys()
    for (a, b), path in got.items():
        assert path[0] == a and path[-1] == b and len(path) == want[a, b] + 1 and all(e in edges for e in zip(path, path[1:], strict=False))


def test_reduction_agrees_with_the_graph_of_columns(spark):
    mutual = {("x", "y"), ("y", "x"), ("y", "n00")}
    for edges in (DAG, DAG | mutual, {("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")}, {("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "c")}):
        df = frame(spark, edges)
        assert pairs(graphs.reduced(df)) == set(relations.reduced(sorted(edges)))
        assert graphs.is_acyclic(df) == relations.is_acyclic(sorted(edges))
    gone = {(r.src, r.dst): r.path for r in graphs.removed(frame(spark, DAG | mutual)).collect()}
    kept = set(relations.reduced(sorted(DAG | mutual)))
    assert gone.keys() == (DAG | mutual) - kept and gone["y", "x"] == ["x", "y"]
    for (a, b), path in gone.items():
        if (b, a) not in kept:
            assert path[0] == a and path[-1] == b and len(path) > 2 and all(e in kept for e in zip(path, path[1:], strict=False))


def test_graphs_without_edges(spark):
    none = frame(spark, [("a", "b")]).limit(0)
    assert graphs.closure(none).count() == graphs.reduced(none).count() == graphs.removed(none).count() == 0 and graphs.is_acyclic(none)


def test_no_join_of_rounds_is_a_broadcast(spark, monkeypatch):
    plans, written = [], graphs.materialised

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(graphs, "materialised", noted)
    df = frame(spark, DAG)
    for out in (graphs.closure(df), graphs.removed(df)):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_pairs_without_cycles_are_made_level_by_level(spark, monkeypatch):
    want, df = distances(DAG), frame(spark, DAG)
    with monkeypatch.context() as m:
        m.setattr(graphs, "materialised", None)  # which rounds of semi-naive evaluation need
        assert {(r.src, r.dst): r.steps for r in graphs.closure(df).collect()} == want
        most = df.select("src").distinct().filter("src > 'n02'")
        assert {(r.src, r.dst): r.steps for r in graphs.closure(df, most).collect()} == {k: v for k, v in want.items() if k[0] > "n02"}
    monkeypatch.setattr(graphs, "LEVELS", 2)  # deeper graphs are settled by rounds
    assert {(r.src, r.dst): r.steps for r in graphs.closure(df).collect()} == want
    assert graphs._levels(df.distinct()) is None and graphs._levels(frame(spark, CYCLIC)) is None
