"""Readers, cleaning, filling, batches and sessions on small tables with known answers."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tabweave.functions.text import json_mapping
from tabweave.operators import batches, clean, covariance, impute
from tabweave.session import Session
from tabweave.sources import readers


def test_strip_and_counters(spark):
    df = spark.createDataFrame([(1, " x"), (2, "\tx"), (3, "\nx "), (4, "  "), (5, None), (6, "y")], "initial_id long, t string")
    assert [r.t for r in clean.strip_texts(df).orderBy("initial_id").collect()] == ["x", "x", "x", None, None, "y"]
    assert clean.space_counters(df).first().blanked == 1


def test_useless_columns_and_empty_rows(spark):
    df = spark.createDataFrame([(i, None if i else "x", "c", str(i), None) for i in range(100)] + [(100, None, None, None, None)], "initial_id long, sparse string, constant string, value string, empty string")
    out = clean.clean_import(df)
    assert out.columns == ["initial_id", "value"] and out.count() == 100


def test_duplicates_keep_the_first_row(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1)], "initial_id long, x string, y long")
    assert sorted((r.initial_id, r.x) for r in clean.drop_duplicates(df).collect()) == [(1, "a"), (2, "b")]
    assert clean.drop_duplicates(df, include_id=True).count() == 3


def test_merge_fills_and_turns_unequal_types_to_text(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, a string"), spark.createDataFrame([("2", True)], "k string, b boolean")
    rows = {r.k: (r.a, r.b) for r in clean.merge([a, b], useless=False).collect()}
    assert rows == {"1": ("x", None), "2": (None, True)}


def test_csv_of_both_encodings(spark, tmp_path):
    for name, encoding in (("u.csv", "utf-8"), ("l.csv", "latin-1")):
        (tmp_path / name).write_bytes('k,t,n\n1,"é, ""q""",NA\n2,b,1.5\n'.encode(encoding))
        df = readers.read_table(spark, str(tmp_path / name))
        assert dict(df.dtypes) == {"k": "bigint", "t": "string", "n": "double"}
        assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, 'é, "q"', None), (2, "b", 1.5)]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "x.pdf")


def workbook(path, rows):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    body = "".join(f"<row>{''.join(cell(v) for v in r)}</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_spreadsheets(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["name", "n"], ["x", 1], ["y", 2]])
    df = readers.read_table(spark, str(tmp_path / "a.xlsx"))
    assert sorted(tuple(r) for r in df.collect()) == [("x", 1), ("y", 2)]
    with pytest.raises(ValueError, match="xls"):
        readers.read_table(spark, "old.xls")


def test_fills_of_unknown_and_single_groups(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, None), (4, "z", None), (5, "b", "y")], "initial_id long, k string, t string")
    got = {r.initial_id: (r.prediction, r.probability) for r in impute.fills(df, "t", ["k"], 1.0, 1.0, least=0.0).collect()}
    assert got == {2: ("x", 1.0)}
    numbers = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "a", None)], "initial_id long, k string, t double")
    assert impute.predictions(numbers, "t", ["k"]).first().probability == 1.0


def test_later_fills_see_earlier_ones(spark):
    rows = [(i, "ab"[i % 2], "xy"[i % 2], "pq"[i % 2]) for i in range(40)] + [(40, "a", None, None)]
    df = spark.createDataFrame(rows, "initial_id long, k string, t string, u string")
    first, second = ({"target": t, "columns": [k], "mean_mi": 1.0, "max_mi": 1.0} for t, k in (("t", "k"), ("u", "t")))
    at = lambda out: tuple(out.filter("initial_id = 40").select("t", "u").first())
    assert at(impute.fill(df, second)) == (None, None)
    assert at(impute.fill(impute.fill(df, first), second)) == ("x", "p")
    assert at(impute.fill_all(df, top_k=1)) == ("x", "p")


def test_batches(spark):
    assert batches.pack([10, 30, 50, 5, 40]) == [1, 1, 2, 3, 3]
    df = spark.createDataFrame([(i, g) for i, g in enumerate([g for g, n in zip("abcde", (10, 30, 50, 5, 40)) for _ in range(n)] + [None])], "initial_id long, g string")
    got = batches.by_group(df, "g")
    assert got.count() == 135 and {(r.g, r.batch_id) for r in got.select("g", "batch_id").distinct().collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 3)}


class Failing:
    def ask(self, prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return json.dumps({"rows": []})


def test_failed_calls_become_rows(spark):
    asked = spark.createDataFrame([(1, "bad"), (2, "good")], "batch_id long, prompt string")
    got = {r.batch_id: r.error for r in batches.ask_all(asked, Failing).collect()}
    assert got == {1: "RuntimeError: no", 2: None}


def test_mappings_from_broken_replies(spark):
    df = spark.createDataFrame([('x {"a": "A"} y',), ('{"b": "B",',), ("none",)], "reply string")
    assert sorted(tuple(r) for r in df.select(F.explode(json_mapping(F.col("reply")))).collect()) == [("a", "A"), ("b", "B")]


def test_clustering_order():
    import numpy as np

    d = np.array([[0, 9, 1], [9, 0, 8], [1, 8, 0]], float)
    for method in ("single", "complete", "average", "ward"):
        merges = covariance.linkage(d, method)
        assert merges[0][:3].tolist() == [0, 2, 1] and sorted(covariance.leaves(merges, 3)) == [0, 1, 2]
    assert covariance.leaves(covariance.linkage(np.zeros((1, 1))), 1) == [0]


def test_sessions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "x string, y long")
    s = Session.of(df)
    assert [r.initial_id for r in s.processed.orderBy("initial_id").collect()] == [1, 2, 3]
    t = s.with_result(("x", "y"), 1).drop("y").deduplicate()
    assert t.columns == ["x"] and t.processed.count() == 2 and not t.results and s.columns == ["x", "y"]
    assert len(t.last_log(2)) == 2 and t.has_data()


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_fixed_batches_keep_wide_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(0, 150_000, 1, 8).select(((F.col("id") * 7919) % 150_000).alias("initial_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("a"), F.sha2((F.col("id") + 1).cast("string"), 512).alias("b"))
        wrong = (F.col("batch_id") != F.floor(F.col("initial_id") / 10) + 1) | (F.col("local_id") != F.col("initial_id") % 10 + 1) | F.col("a").isNull() | F.col("b").isNull()
        r = batches.fixed(df).agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.countDistinct("a", "b").alias("rows")).first()
        assert (r.n, r.wrong, r.rows) == (150_000, 0, 150_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_entry_needs_no_session_to_be_imported():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0], timeout=120)
