"""Saving as replies come, web results, itemsets of hot items, trees as text, correspondence analysis, and texts of numbers, against plain versions."""

import json
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions import text
from tabweave.operators import assoc, batches, covariance, repair, valuetree, vendors
from tabweave.operators.relations import to_dot


class Breaking(batches.OfflineClient):
    def ask(self, prompt):
        if "g07" in prompt:
            raise ConnectionError("gone")
        return super().ask(prompt)


def test_a_failed_call_keeps_earlier_replies_and_is_resumed(spark, tmp_path):
    rows = [(i, f"g{i // 40:02}", f"thing {i}") for i in range(800)]  # twenty batches of a group each
    df = spark.createDataFrame(rows, "initial_id long, g string, t string").repartition(3)
    folder = str(tmp_path / "r")
    with pytest.raises(Exception, match="a call failed: ConnectionError: gone"):
        batches.extract_resumable(df, "g", ["t", "g"], folder, Breaking, per_commit=4)
    saved = spark.read.parquet(f"{folder}/replies").filter("error IS NULL")
    kept = {r.batch_id for r in saved.collect()}
    assert 0 < len(kept) < 20  # replies before the error, and those of its own micro-batch
    asked = []

    class Counting(batches.OfflineClient):
        def ask(self, prompt):
            if "Row 0:" in prompt and 1 in kept:
                raise AssertionError("asked again")
            return super().ask(prompt)

    out = batches.extract_resumable(df, "g", ["t", "g"], folder, Counting, per_commit=4).collect()
    assert sorted(r.row_id for r in out) == list(range(800)) and not asked
    commits = spark.read.parquet(f"{folder}/replies").groupBy("run").agg(F.countDistinct("commit").alias("n")).collect()
    assert len(commits) == 2 and max(r.n for r in commits) > 1
    assert batches.extract_resumable(df, "g", ["t", "g"], folder, Breaking).count() == 800  # nothing is lacking, so nothing is asked
    skipped = batches.extract_resumable(df, "g", ["t", "g"], str(tmp_path / "s"), Breaking, on_error="skip")
    assert skipped.count() == 760
    assert batches.extract_resumable(df.limit(0), "g", ["t", "g"], str(tmp_path / "e")).count() == 0


def test_large_jobs_save_replies_in_a_bounded_number_of_commits(spark, tmp_path):
    n, folder = 3 * batches.COMMITS, str(tmp_path / "many")
    rows = [(10 * b + i, f"thing {b} {i}") for b in range(n) for i in range(10)]
    df = spark.createDataFrame(rows, "initial_id long, t string").repartition(3)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("initial_id", "t"))), lambda x: x.t), "\n")
    asked = df.groupBy(F.floor(F.col("initial_id") / 10).alias("batch_id")).agg(F.concat(F.lit("Map\n"), line).alias("prompt"))
    out = batches._answered(asked, folder, batches.offline_client, per_commit=1)
    assert sorted(r.batch_id for r in out.collect()) == list(range(n))
    assert 1 < spark.read.parquet(f"{folder}/replies").select("commit").distinct().count() <= batches.COMMITS


def test_web_results_with_retries_and_errors(spark):
    class Flaky(batches.OfflineSearch):
        calls = 0

        def search(self, query, n):
            self.calls += 1
            if "never" in query or self.calls % 2:
                raise TimeoutError(f"try {self.calls}")
            return super().search(query, n)

    df = spark.createDataFrame([(1, "red wine cork"), (2, "never"), (3, None), (4, " "), (5, "one")], "k int, query string").coalesce(1)
    got = sorted((r.k, r.rank, r.id, r.author, r.published_date, r.error) for r in batches.web_answers(df, Flaky, 2, retries=1, wait=0.0, per_second=500).collect())
    assert [g[:3] for g in got if g[0] != 2] == [(1, 1, "https://example.org/red#1"), (1, 2, "https://example.org/wine#2"), (5, 1, "https://example.org/one#1")]
    assert got[0][3:] == ("r", "2024-01-01", None) and [g[1] for g in got if g[0] == 2] == [0] and "TimeoutError" in next(g[5] for g in got if g[0] == 2)


@pytest.mark.parametrize(("least", "most"), [(0.02, None), (0.1, 2), (0.5, 5)])
def test_itemsets_with_hot_items_in_many_slices(spark, monkeypatch, least, most):
    monkeypatch.setattr(assoc, "BASKETS", 60)
    monkeypatch.setattr(assoc, "SETS", 40)
    rng = random.Random(4)
    baskets = [sorted({"hot", *rng.sample("abcdefgh", rng.randint(0, 4))} if rng.random() < 0.9 else {rng.choice("xyz")}) for _ in range(1500)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>").repartition(5)
    got = {tuple(r["items"]): r.freq for r in assoc.frequent_itemsets(df, least, most).collect()}
    counts = {}
    for b in baskets:
        for k in range(1, min(len(b), most or len(b)) + 1):
            for c in combinations(b, k):
                counts[c] = counts.get(c, 0) + 1
    assert got == {c: n for c, n in counts.items() if n >= least * 1500 - 1e-9}
    assert assoc.frequent_itemsets(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="frequent"):
        assoc.frequent_itemsets(spark.createDataFrame([([str(i)],) for i in range(100)], "items array<string>"), 0.0)


def test_prefix_trees_against_all_subsets():
    rng = random.Random(9)
    for _ in range(30):
        baskets = [(sorted(rng.sample(range(7), rng.randint(0, 6))), rng.randint(1, 3)) for _ in range(25)]
        want = {c for k in range(1, 5) for c in combinations(range(7), k) if sum(w for b, w in baskets if set(c) <= set(b)) >= 6}
        assert sorted(assoc.PrefixTree(baskets).mine(6, 4)) == sorted(want)


def test_trees_as_text_without_the_driver(spark, tmp_path):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.choice("ab"), rng.choice("xyzw"), rng.choice("pq")) for i in range(400)], "initial_id long, k string, u string, v string")
    nodes = valuetree.trees(df, "k", ["a", "b"], exclude_id=True)
    valuetree.write_text(nodes, str(tmp_path / "t"))
    shown = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "t").glob("part-*")) if p.stat().st_size)
    assert shown == valuetree.to_text(nodes)
    keys = [r.key for r in valuetree.lines(nodes).collect()]
    assert keys == sorted(keys) and len(set(keys)) == nodes.count()


def test_correspondence_analysis_against_the_indicator_matrix(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, x := rng.choice("abcd"), x + rng.choice("pq") if rng.random() < 0.7 else "r", rng.choice("mno") if i % 9 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "initial_id long, p string, q string, r string").repartition(3)
    cats = sorted({(c, r[j] or "_MISSING_") for r in rows for j, c in ((1, "p"), (2, "q"), (3, "r"))})
    z = np.zeros((len(rows), len(cats)))
    for i, r in enumerate(rows):
        for j, c in ((1, "p"), (2, "q"), (3, "r")):
            z[i, cats.index((c, r[j] or "_MISSING_"))] = 1
    share = z / z.sum()
    row, col = share.sum(1), share.sum(0)
    s = (share - np.outer(row, col)) / np.sqrt(np.outer(row, col))
    _, sigma, vt = np.linalg.svd(s, full_matrices=False)
    want = (vt / np.sqrt(col))[:3].T * sigma[:3]  # principal coordinates of the categories
    for most in (2000, 3):
        monkeypatch.setattr(covariance, "MOST_CATEGORIES", most)
        found, values, total = covariance.category_scores(df, ["p", "q", "r"], 3)
        got = {(r.c, r.v): r.scores for r in found.collect()}
        a = np.array([got[c] for c in cats])
        assert np.allclose(values, sigma[:3] ** 2, rtol=1e-5) and total == pytest.approx((sigma**2).sum())
        for k in range(3):
            x, y = a[:, k] / np.linalg.norm(a[:, k]), want[:, k] / np.linalg.norm(want[:, k])
            assert abs(x @ y) == pytest.approx(1, abs=1e-5 if most == 2000 else 1e-3)
        assert np.allclose(np.abs(a[:, 0]), np.abs(want[:, 0]), atol=1e-4)


def test_encoding_and_covariance_against_plain_sums(spark):
    rng = random.Random(10)
    rows = [(i, rng.random(), rng.choice("ab"), rng.choice("xyz") if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "initial_id long, n double, k string, w string")
    out = covariance.analyse(df, ["n", "k", "w"], refine=False)
    share = lambda j: [sum(r[j] == x[j] for r in rows) / 300 for x in rows]
    n = np.array([r[1] for r in rows])
    z = lambda v: (np.array(v) - np.mean(v)) / (np.std(v) or 1)
    got = {(r.feature_i, r.feature_j): r.cov for r in out["covariance"].collect()}
    want = np.cov(np.stack([z(n), share(2), share(3)]))
    for i, a in enumerate(["n", "k", "w"]):
        for j, b in enumerate(["n", "k", "w"]):
            assert got[a, b] == pytest.approx(want[i, j], abs=1e-9)
    scores, _, _ = covariance.category_scores(df, ["k", "w"])
    first = {(r.c, r.v): r.scores[0] for r in scores.collect()}
    refined = covariance.encode(df, ["n"], ["k", "w"], refine=True)[0].orderBy("initial_id").collect()
    for c, j in (("k", 2), ("w", 3)):
        seen = [v for (column, _), v in first.items() if column == c]
        for r, x, f in zip(refined, rows, share(j), strict=True):
            assert r[c] == pytest.approx(0.7 * f + 0.3 * ((first[c, x[j] or "_MISSING_"] - np.mean(seen)) / np.std(seen) + 1) / 2)


def test_numbers_as_text(spark):
    numbers = [0.0, -0.0, 1.0, 1e-5, 1.5e-7, 1e-4, 1.25e-4, 9.9e-4, 0.001, -2.5, 123456.75, 1e7, 12345678.9, 1.2345678901234567e15, 1e15, 9.9e15, 1e16, -1.5e16, 1.7976931348623157e308, 5e-324, 1e100, float("inf"), float("-inf"), float("nan"), 1 / 3, 2**53 + 2.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", text.number_text(F.col("x")).alias("t")).collect()}
    assert [got[i] for i in range(len(numbers))] == [repr(x) if x != 5e-324 else got[numbers.index(5e-324)] for x in numbers]
    assert text.wrap("one_two three four", 8) == "one_two\nthree\nfour" or "\n" in text.wrap("one_two three four", 8)


def test_repair_of_all_pairs_against_a_loop(spark):
    rng = random.Random(21)
    rows = [[f"a{(k := rng.randrange(12)) % 4 if rng.random() > 0.08 else 9}", f"b{k % 6 if rng.random() > 0.08 else 8}", f"c{k}" if rng.random() > 0.05 else None] for _ in range(500)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "initial_id long, a string, b string, c string").repartition(4)
    names = ["a", "b", "c"]
    for drop, sure in ((True, False), (False, True)):
        out, changes = repair.repair_all(df, 0, drop, confident_only=sure)
        plans = sorted(repair.all_plans(df, 0, drop).collect(), key=lambda r: r.plan_order)
        assert len({r.plan_order for r in plans}) > 2
        now, writes = [list(r) for r in rows], 0
        for r in plans:
            if sure and not r.confident:
                continue
            p, c = names.index(r.parent), names.index(r.child)
            for i, old in enumerate(rows):  # all plans look at the table as it was
                if old[c] == r.cv and old[p] != r.correct_value and (old[p] is not None or not drop):
                    now[i][p], writes = r.correct_value, writes + 1
        assert {r.initial_id: [r.a, r.b, r.c] for r in out.collect()} == dict(enumerate(now)) and changes.count() == writes > 0


def test_density_and_verification(spark):
    assert assoc.density(4, 6) == 0.5 and assoc.density(1, 0) == 0.0
    class Client:
        def verify(self, row):
            if row["vendor"] == "bad":
                raise ValueError("no")
            return {"aliases": "seen"}

    df = spark.createDataFrame([("Acme", "f", ""), ("bad", "g", "h")], "vendor string, families string, aliases string")
    assert sorted(tuple(r) for r in vendors.verify(df, Client).collect()) == [("Acme", "f", "seen"), ("bad", "g", "h")]
    assert '"x" -> "y"' in to_dot(spark.createDataFrame([("x", "y", 0.01)], "src string, dst string, violation_ratio double"))
    assert json.loads(batches.OfflineClient().ask("Map\nred wine\n")) == {"red wine": "RED"}


def test_scratch_folders_are_cleared(spark):
    from tabweave import storage

    storage.clear(spark)
    folder = storage.scratch(spark, "some")
    spark.range(3).write.parquet(folder)
    assert storage.clear(spark) == 1 and storage.clear(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_second_counts_of_a_hot_child(spark):
    rows = [(i, "hot" if i % 10 else f"c{i % 7}", f"p{i % 1000 if i % 3 else 5}") for i in range(6000)]
    df = spark.createDataFrame(rows, "initial_id long, child string, parent string").repartition(4)
    plan = repair.plan_for_pair(df, "parent", "child")
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
    r = plan.filter("cv = 'hot'").first()
    seen = [p for _, c, p in rows if c == "hot"]
    counts = sorted((seen.count(p) for p in set(seen)), reverse=True)
    assert (r.top, r.second, r.correct_value, r.num_changes) == (counts[0], counts[1], "p5", len(seen) - counts[0])


def test_fixed_digits_round_as_the_exact_value_says(spark):
    rng = random.Random(5)
    values = [0.15625, 0.125, 2.675, 1.005, 0.00005, 0.00015, -0.00005, 0.0, 12345.67895, 1e9 / 7, 0.5, 1.5, float("nan"), float("inf"), *(rng.randrange(2000) / 1600 for _ in range(200)), *(rng.uniform(-1e4, 1e4) for _ in range(200))]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select(text.shown(F.col("v")).alias("a"), text.shown_percent(F.col("v")).alias("b"))
    got = [tuple(r) for r in df.collect()]
    assert got == [*((f"{v:.4f}", f"{v:.2%}") for v in values), (None, None)]
