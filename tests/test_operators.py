"""Positions, batches, model calls, sinks, trees, rules and analyses on small tables with known or brute-force answers."""

import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions import colors, text
from tabweave.operators import assoc, batches, clean, covariance, impute, pairs, valuetree, vendors
from tabweave.session import Session
from tabweave.sources import readers, sinks
from tabweave.storage import numbered, quantiles, running


def test_positions_and_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "initial_id long, k string, n long").repartition(7)
    got = {r.initial_id: (r.at, r.before) for r in running(numbered(df, "at", ["k", "initial_id"]), F.col("n"), "before", ["k", "initial_id"]).collect()}
    before = 0
    for at, (i, _, n) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        assert got[i] == (at, before)
        before += n
    wide = spark.range(5000).select(F.col("id").alias("initial_id"), F.repeat(F.lit("x"), 300).alias("pad")).repartition(9)
    assert sorted(r.at for r in numbered(wide, "at", ["initial_id"]).filter("at = initial_id").collect()) == list(range(5000))


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=801), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    assert np.allclose(quantiles(df, F.col("v"), shares), np.quantile(x, shares))
    assert quantiles(df.limit(0), F.col("v"), shares) == [] and quantiles(df.filter("v IS NOT NULL").limit(1), F.col("v"), [0.5])


def test_medians_by_group(spark):
    rows = [("a", float(v)) for v in (3, 1, 2, 2)] + [("b", 5.0), ("b", 8.0), ("c", None), (None, 1.0)]
    got = {r.k: (r.n, r.median, r["mode"]) for r in impute.numeric_stats(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert got == {"a": (4, 2.0, 2.0), "b": (2, 6.5, 5.0)}


@pytest.mark.parametrize("parts", [1, 6])
def test_batches_of_groups_as_in_a_plain_fold(spark, parts):
    rng = random.Random(3)
    rows, i = [], 0
    for g in range(60):
        for _ in range(rng.choice([1, 3, 9, 20, 34, 35, 49, 50, 51, 120, 149])):
            rows.append((i := i + 1, f"g{g:02}", "x" * 50))
    rows += [(i + 1, None, "x")]
    df = spark.createDataFrame(rows, "initial_id long, g string, pad string").repartition(parts)
    blocks = {}
    for k, g, _ in sorted(rows[:-1]):
        at = blocks.setdefault(g, [[]])
        if len(at[-1]) == 50:
            at.append([])
        at[-1].append(k)
    flat = [b for g in sorted(blocks) for b in blocks[g]]
    want = {k: n for b, n in zip(flat, batches.pack(map(len, flat)), strict=True) for k in b}
    got = batches.by_group(df, "g").collect()
    assert {r.initial_id: r.batch_id for r in got} == want and len(got) == len(rows) - 1


class Client(batches.OfflineClient):
    def ask(self, prompt):
        if "bad" in prompt:
            raise ConnectionError("no")
        if '"vendors"' in prompt:
            lines = [x.split(";") for x in prompt.splitlines() if x.count(";") == 2 and "{" not in x and "form" not in x]
            return json.dumps({"vendors": [{"vendor": lines[0][0].upper(), "families": "", "aliases": ",".join(x[0] for x in lines)}]})
        return super().ask(prompt)


def test_labels_lead_back_to_rows_and_failed_batches_are_asked_again(spark, tmp_path):
    rows = [(i, f"{'bad' if 20 < i <= 24 else 'ok'}{i} thing") for i in range(1, 36)]
    df = spark.createDataFrame(rows, "initial_id long, t string").repartition(4)
    folder = str(tmp_path / "replies")
    first = {r.initial_id: r.product_code for r in batches.label_rows(df, ["t"], "product_code", batches.CODE_PROMPT, folder, Client).collect()}
    assert all(first[i] == (f"OK{i}" if not 20 < i <= 30 else "") for i in first) and len(first) == 35
    again = {r.initial_id: r.product_code for r in batches.label_rows(df, ["t"], "product_code", batches.CODE_PROMPT, folder).collect()}
    assert again[22] == "BAD22" and again[3] == "OK3"
    kept = df.withColumn("product_category", F.lit("mine"))
    got = {r.initial_id: r.product_category for r in batches.label_rows(kept, ["t"], "product_category", batches.CATEGORY_PROMPT, str(tmp_path / "c"), Client).collect()}
    assert got[1] == "thing" and got[21] == "mine"


def test_simplifying_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "red wine"), (2, "red car"), (3, None), (4, "  "), (5, "bad one")], "initial_id long, v string")
    out, mapping = batches.simplify(df, "v", str(tmp_path / "m"), Client, size=2)
    assert {r.original: r.simplified for r in mapping.collect()} == {"red wine": "RED"}
    assert {r.initial_id: r.v_simplified for r in out.collect()} == {1: "RED", 2: "red car", 3: None, 4: "  ", 5: "bad one"}


def test_prompts_leave_blank_rows_out_and_configuration(spark):
    df = spark.createDataFrame([(1, " ", None, 1), (2, "a", None, 1)], "initial_id long, x string, y string, batch_id long")
    assert batches.prompts(df, ["x", "y"]).first().prompt.count("Row ") == 1
    assert batches.lacking({"endpoint": "e", "key": " "}) == ["key", "deployment"]
    filled = batches.with_vendors(batches.EXTRACT_PROMPT, [("Acme", ["A1", "acme"]), ("Bolt", [])])
    assert "Acme: A1, acme\nBolt\n" in filled and "[vendors]" not in filled


def test_vendors_merged_by_a_model(spark):
    df = spark.createDataFrame([("Acme", "a", ""), ("Acme Inc", "b", ""), ("bad", "", ""), ("Crane", "", "c")], "vendor string, families string, aliases string")
    got = [tuple(r) for r in vendors.merge_by_model(df, Client).collect()]
    assert got == [("ACME INC", "", "Acme Inc,Acme"), ("CRANE", "", "Crane")]
    assert [r.vendor for r in vendors.merge_by_model(df, Client, keep=True).collect()] == ["ACME INC", "bad", "CRANE"]


def test_encodings_raise_or_keep_all_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "é €")], "initial_id long, t string")
    before = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    sinks.write_csv(df, str(tmp_path / "w"), "cp1252", single=True)
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == before
    part = next((tmp_path / "w").glob("*.csv"))
    assert part.read_bytes().decode("cp1252").split() == ["t", "é", "€"]
    for encoding, bad in (("cp1252", "日本"), ("cp1252", "\x81"), ("latin-1", "€"), ("iso-8859-1", "Ž")):
        with pytest.raises(UnicodeError):
            sinks.write_csv(spark.createDataFrame([(1, bad)], "initial_id long, t string"), str(tmp_path / "x"), encoding)
    assert sinks.stamped("merged").startswith("merged_2") and sinks.stamped("a", ".txt").endswith(".txt")
    sinks.write_semicolon(df, str(tmp_path / "s"))
    assert readers.read_semicolon(spark, str(tmp_path / "s")).first().t == "é €"


def test_colours_of_missing_shares(spark):
    shares = [-1.0, 0.0, 0.1, 0.15, 0.3, 0.5, 2.0]
    df = spark.createDataFrame([(x,) for x in shares], "s double")
    assert [r.c for r in df.select(colors.of_missing(F.col("s")).alias("c")).collect()] == ["#006400", "#006400", "#5C4F0C", "#8B4513", "#8B270A", "#8B0000", "#8B0000"]


def test_formats_hashes_and_json(spark):
    df = spark.createDataFrame([(1234567, 0.12345, float("nan"), "a", None)], "n long, p double, bad double, t string, none string")
    r = df.select(text.shown(F.col("p")), text.shown_percent(F.col("p")), text.shown_thousands(F.col("n")), text.short_hash(F.col("t"), F.col("none")), text.json_row(df)).first()
    assert r[:3] == ("0.1235", "12.35%", "1,234,567") and len(r[3]) == 8
    assert json.loads(r[4]) == {"n": 1234567, "p": 0.12345, "bad": None, "t": "a", "none": None}


def test_label_encoding_and_counts(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", " "), (3, None, None), (4, "b", "y")], "initial_id long, k string, v string")
    assert [r.k for r in clean.label_encoded(df, "k").orderBy("initial_id").collect()] == [1, 0, None, 1]
    assert clean.report_counts(df, "v", "k").first().asDict() == {"rows": 4, "filled": 2, "groups": 2, "rows_per_group": 1.5}
    assert clean.report_counts(df.limit(0), "v", "k").first().asDict() == {"rows": 0, "filled": 0, "groups": 0, "rows_per_group": 0.0}
    assert clean.with_default(df, "v").columns == df.columns and clean.with_default(df, "w", "").first().w == ""


def test_first_sheet_by_the_workbook(spark, tmp_path):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = lambda v: f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{cell("name")}</row><row>{cell(v)}</row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet("second"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("first"))
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="B" sheetId="2" r:id="rId2"/><sheet name="A" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
    assert readers.read_table(spark, str(tmp_path / "a.xlsx")).first().name == "first"


def test_a_changed_file_is_read_again(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n1,x\n2,y\n")
    one = Session.load(spark, str(path))
    assert Session.load(spark, str(path), one) is one
    path.write_text("k,v\n1,x\n2,y\n3,z\n")
    two = Session.load(spark, str(path), one)
    assert two is not one and two.processed.count() == 3


def test_itemsets_and_rules_against_brute_force(spark):
    from itertools import combinations

    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.choice("mn") if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "initial_id long, p string, q string, r string")
    sets, rules = assoc.mine(df, ["p", "q", "r"], 0.1, 0.3)
    baskets = [{f"p={p}", f"q={q}", f"r={r or 'NA'}"} for _, p, q, r in rows]
    items = sorted(set().union(*baskets))
    want = {c: sum(set(c) <= b for b in baskets) / 300 for k in (1, 2, 3) for c in combinations(items, k)}
    want = {c: s for c, s in want.items() if s >= 0.1}
    got = {tuple(r["items"]): r.support for r in sets.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c]) for c in got)
    expected = {(a, tuple(sorted(set(c) - set(a)))) for c in want if len(c) > 1 for k in range(1, len(c)) for a in combinations(c, k) if want[c] / want[a] >= 0.3}
    assert {(tuple(r.antecedent), tuple(r.consequent)) for r in rules.collect()} == expected
    ranked = [(r["size"], -r.support) for r in assoc.sort_itemsets(sets).collect()]
    assert ranked == sorted(ranked)


def test_trees_and_their_exports(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", None), (5, "b", None), (6, "c", "z")], "initial_id long, k string, v string")
    assert valuetree.top_values(df, "k", 2) == ["a", "b"] and valuetree.top_values(df.drop("initial_id"), "v", 3) == ["<NA>", "x", "y"]
    tree = valuetree.trees(df, "k", ["a", "b"], exclude_id=True)
    nested = valuetree.nested(tree)
    assert [(c["value"], c["count"]) for c in nested["a"]["children"]] == [("x", 2), ("y", 1)] and nested["b"]["children"][0]["value"] == "<NA>"
    assert "v = x (66.67%, 2)" in valuetree.to_text(tree) and json.loads(valuetree.to_json(tree)).keys() == {"a", "b"}


def test_ranked_results_and_errors(spark):
    df = spark.createDataFrame([(i, f"k{i}", f"g{i % 4}", "z" if i == 7 else f"h{i % 2}") for i in range(40)], "initial_id long, k string, g string, h string")
    got = [(r.parent, r.child) for r in pairs.analyse_one_to_many(df, 95).collect()]
    assert got == [("g", "k"), ("h", "k")]
    assert [(r.parent, r.child, round(r.violation_ratio, 3)) for r in pairs.analyse_errors(df).collect()][-1] == ("h", "g", 0.25)


def test_correspondence_analysis_by_iteration(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, x := rng.choice("abcd"), x + rng.choice("pq") if rng.random() < 0.7 else "r", rng.choice("mno") if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "initial_id long, p string, q string, r string")
    one, values, total = covariance.category_scores(df, ["p", "q", "r"], 3)
    monkeypatch.setattr(covariance, "MOST_CATEGORIES", 3)
    monkeypatch.setattr(covariance, "ROUNDS", 30)
    two, other, _ = covariance.category_scores(df, ["p", "q", "r"], 3)
    assert np.allclose(values, other, rtol=1e-3) and 0 < values.sum() <= total
    a, b = ({(r.c, r.v): r.scores for r in x.collect()} for x in (one, two))
    assert all(abs(a[k][0] - b[k][0]) < 0.02 for k in a)


def test_covariance_analysis(spark):
    rng = random.Random(9)
    rows = [(i, float(i), 2.0 * i + rng.random(), "ab"[i > 100], "xy"[i % 2]) for i in range(200)]
    out = covariance.analyse(spark.createDataFrame(rows, "initial_id long, u double, v double, k string, w string"), ["u", "v", "k", "w"], refine=True)
    assert out["rows"] == 200 and len(out["order"]) == 4 and 0 < out["explained_inertia"].sum() <= 1 + 1e-9
    at = {c: i for i, c in enumerate(out["order"])}
    assert abs(at["u"] - at["v"]) == 1


def test_streams_of_arriving_files(spark, tmp_path):
    from tabweave.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("t,v\n2024-01-01 00:10:00, x \n2024-01-01 00:20:00,  \n2024-01-01 09:00:00,y\n")
    stream = ingest.cleaned_stream(spark, str(tmp_path / "in"), "t timestamp, v string")
    query = ingest.write_stream(ingest.missing_per_window(stream, "t", ["v"]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(60)
    (tmp_path / "in" / "b.csv").write_text("t,v\n2024-01-01 20:00:00,z\n2024-01-01 00:30:00,late\n")
    query = ingest.write_stream(ingest.missing_per_window(ingest.cleaned_stream(spark, str(tmp_path / "in"), "t timestamp, v string"), "t", ["v"]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(60)
    got = {r.window.start.hour: (r["rows"], r.na_v) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == (2, 1)
