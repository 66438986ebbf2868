"""Operators on columns whose names hold dots and backticks, or are those of results: as on plain names."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tabweave.functions.text import json_row
from tabweave.operators import assoc, batches, clean, covariance, impute, pairs, repair, valuetree
from tabweave.session import Session
from tabweave.sources import readers, sinks

NAMES = {"a": "a.1", "b": "Nr. crt.", "v": "v`x", "w": "n", "t": "value"}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, "pqrs"[i % 4] if i % 9 else None, f" {'pqrs'[i % 4].upper()}x" if i % 11 else "odd", float(i % 13) if i % 7 else None, i % 5, "u v" if i % 3 else "") for i in range(1, 121)]
    plain = spark.createDataFrame(rows, "initial_id long, a string, b string, v double, w int, t string").checkpoint()
    return plain, plain.toDF("initial_id", *NAMES.values())


def rows_of(out, names=NAMES):
    """What an operator gives, with the odd names put back; names of results that equal one change on either side alike."""

    def back(x):
        if isinstance(x, str):
            for plain, name in names.items():
                x = plain if x == name else x.replace(f"{name}=", f"{plain}=").replace(f'"{name}":', f'"{plain}":').replace(f"{name} | ", f"{plain} | ").replace(f" | {name}", f" | {plain}")
                x = x.replace(f"{name}_simplified", f"{plain}_simplified").replace(f"na_{name}", f"na_{plain}") if x.startswith((name, "na_")) else x
            return x
        if isinstance(x, dict):
            return {back(k): back(v) for k, v in x.items()}
        return [back(y) for y in x] if isinstance(x, list | tuple) else round(x, 9) if isinstance(x, float) else x

    if hasattr(out, "collect"):
        return back(list(out.columns)), sorted((back(list(r)) for r in out.collect()), key=repr)
    return back(out)


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def written(df):
    path = f"{folder()}/out"
    sinks.write_semicolon(df.select("initial_id", *(F.col(f"`{c.replace('`', '``')}`") for c in df.columns[1:3])), path)
    return readers.read_semicolon(df.sparkSession, path)


RUNS = {
    "null_profile": lambda d, n: pairs.null_profile(d),
    "frequencies": lambda d, n: pairs.value_frequencies(d, n["a"], True),
    "one_to_many": lambda d, n: pairs.analyse_one_to_many(d, 0),
    "one_to_one": lambda d, n: pairs.analyse_one_to_one(d, 0),
    "ruled_out": lambda d, n: sorted(sum((sorted(f(d, [(n["a"], n["b"]), (n["v"], n["w"])], 0.9, True, False)) for f in (pairs._sampled_out, pairs._sketched_out)), [])),
    "errors": lambda d, n: pairs.analyse_errors(d),
    "mask": lambda d, n: pairs.row_mask(d, n["a"], n["b"]),
    "samples": lambda d, n: pairs.samples(d, n["a"], n["b"], False),
    "categorical": lambda d, n: pairs.categorical(d),
    "clean": lambda d, n: clean.clean_import(d),
    "spaces": lambda d, n: clean.space_counters(d),
    "duplicates": lambda d, n: clean.drop_duplicates(d),
    "merge": lambda d, n: clean.merge([d, d.withColumn(n["w"], F.lit("x"))]),
    "concat": lambda d, n: clean.concat_columns(d, n["a"], n["b"]),
    "labels": lambda d, n: clean.label_encoded(d, n["b"]),
    "report": lambda d, n: clean.report_counts(d, n["t"], n["a"]),
    "transactions": lambda d, n: assoc.transactions(d, [n["a"], n["v"]]),
    "rules": lambda d, n: assoc.mine(d, [n["a"], n["b"]])[1],
    "numbers": lambda d, n: impute.numeric_stats(d, n["v"], [n["a"], n["b"]]),
    "shares": lambda d, n: impute.value_shares(d, n["t"], [n["a"]]),
    "information": lambda d, n: impute.mutual_information(d, n["a"]),
    "information_near": lambda d, n: impute.mutual_information(d, n["v"], [n["b"], n["w"]], "neighbours"),
    "fills": lambda d, n: impute.fills(d, n["v"], [n["w"], n["a"]], 0.5, 1.0, 0.0),
    "analysis": lambda d, n: impute.analyse(d, n["v"]),
    "fill_all": lambda d, n: impute.fill_all(d),
    "zscores": lambda d, n: covariance.zscores(d, [n["v"], n["w"]]),
    "covariance": lambda d, n: covariance.analyse(d, [n["a"], n["b"], n["v"]], refine=True)["covariance"],
    "covariance_whole": lambda d, n: covariance.analyse(d, [n["a"], n["v"], n["w"]], drop_na=True)["covariance"],
    "missing": lambda d, n: covariance.missing_report(d, [n["a"], n["v"]]),
    "tree": lambda d, n: valuetree.trees(d.drop("initial_id"), n["a"], valuetree.top_values(d, n["a"], 2), max_depth=2),
    "plan": lambda d, n: repair.plan_for_pair(d, n["a"], n["b"]),
    "repaired": lambda d, n: repair.repair_all(d, 0, columns=[n["a"], n["b"], n["t"]])[0],
    "cells": lambda d, n: repair.cells(d, repair.plan_for_pair(d, n["a"], n["b"]), n["a"], n["b"]),
    "batches": lambda d, n: batches.by_group(d, n["a"], 5, 20),
    "letters": lambda d, n: batches.by_first_letter(d, n["b"]),
    "prompts": lambda d, n: batches.prompts(batches.by_group(d, n["a"], 5, 20), [n["b"], n["w"]], group=n["a"]),
    "labelled": lambda d, n: batches.label_rows(d, [n["b"], n["t"]], "product_code", batches.CODE_PROMPT, folder()),
    "simplified": lambda d, n: batches.mapping_preview(batches.simplify(d, n["b"], folder())[0], n["b"]),
    "reduction": lambda d, n: batches.reduction(batches.simplify(d, n["b"], folder())[0], n["b"]),
    "json": lambda d, n: d.select("initial_id", json_row(d).alias("j")),
    "session": lambda d, n: Session.of(d, cleaned=True).concat(n["a"], n["b"]).drop(n["v"]).deduplicate().processed,
    "semicolon": lambda d, n: written(d),
}


@pytest.mark.parametrize("run", RUNS)
def test_names_make_no_difference(tables, run):
    plain, odd = tables
    assert rows_of(RUNS[run](odd, NAMES)) == rows_of(RUNS[run](plain, {k: k for k in NAMES}))


def test_repeated_headers_can_be_worked_with(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,a,b\n1,x,\n2,y,z\n3,y,w\n")
    df = Session.load(spark, str(tmp_path / "a.csv")).processed
    assert df.columns == ["a", "a.1", "b", "initial_id"] and {r.column: r.nulls for r in pairs.null_profile(df).collect()} == {"a": 0, "a.1": 0, "b": 1}
