"""Column pairs that are ruled out before they are counted, and values with very many partners."""

import random

import pytest
from pyspark.sql import functions as F

from tabweave.operators import pairs


@pytest.fixture
def small_sample(monkeypatch):
    monkeypatch.setattr(pairs, "SAMPLE", 1500)
    monkeypatch.setattr(pairs, "LEAST_SAMPLE", 800)
    monkeypatch.setattr(pairs, "MARGIN", 0.1)


@pytest.fixture(scope="module")
def wide(spark):
    rng, rows = random.Random(12), []
    for i in range(6000):
        key, few = rng.randrange(900), rng.randrange(6)
        rows.append((i, f"k{key}", f"g{key % 40}", f"h{key % 40}" if rng.random() > 0.02 else "odd", f"f{few}", "abc"[few % 3], rng.randrange(3), rng.randrange(2500), rng.randrange(2500), None if rng.random() < 0.3 else rng.randrange(5), "const", str(i), rng.random() < 0.5, f"t{key}"))
    names = "initial_id long, key string, grp string, nearly string, few string, fewer string, noise long, many1 long, many2 long, gaps long, const string, own string, flag boolean, twin string"
    return spark.createDataFrame(rows, names).repartition(5).cache()


@pytest.mark.parametrize("drop", [True, False])
@pytest.mark.parametrize("analyse", [pairs.analyse_one_to_many, pairs.analyse_one_to_one])
def test_pruning_loses_no_result_and_spares_scans(wide, small_sample, monkeypatch, analyse, drop):
    whole = [tuple(r) for r in analyse(wide, 90, drop, prune=False).collect()]
    scanned, count = [], pairs.pair_counts

    def counted(df, todo):
        if df.count() == 6000:
            scanned.extend(todo)
        return count(df, todo)

    monkeypatch.setattr(pairs, "pair_counts", counted)
    assert [tuple(r) for r in analyse(wide, 90, drop).collect()] == whole and whole
    assert len(scanned) <= (36 if analyse is pairs.analyse_one_to_many else 14)  # of 78


def test_sketches_rule_out_pairs_of_many_values(wide, small_sample):
    todo = [("many1", "many2"), ("key", "grp"), ("own", "key")]
    assert pairs._sketched_out(wide, todo, 0.9, True, False) == {("many1", "many2")}
    assert pairs._sketched_out(wide, todo, 0.9, True, True) == set(todo)  # none has exact partners
    assert pairs.may_reach(wide, [("few", "noise"), ("key", "grp"), ("many1", "many2")], 90) == [("key", "grp")]


def test_small_tables_and_no_threshold_keep_all_pairs(spark, wide, small_sample):
    todo = [("few", "noise"), ("many1", "many2")]
    assert pairs.may_reach(wide.limit(100), todo, 99) == todo and pairs.may_reach(wide, todo, 0) == todo


def test_partners_of_one_hot_value_meet_in_no_single_task(spark):
    rows = [(i, "hot" if i % 10 else f"v{i}", i) for i in range(8000)]
    df = spark.createDataFrame(rows, "initial_id long, a string, b long").repartition(4)
    out = pairs.one_to_one(pairs.pair_counts(df, [("a", "b")]), True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    r = out.first()
    assert (r.valid, r.total, r.distinct1, r.distinct2) == (800, 8000, 801, 8000)
    assert df.agg(F.count("*")).first()[0] == 8000
