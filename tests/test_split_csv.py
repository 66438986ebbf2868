"""CSV files in small ranges, against Python's reader of whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tabweave.sources import readers, sinks, split_csv


@pytest.fixture
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, kept[k]) if k in kept else spark.conf.unset(k)


def odd_rows(n, seed=1):
    rng = random.Random(seed)
    values = ["plain", 'with "quotes"', "line\nbreak", "a,b", "", "é", 'open "', "x" * 300, "\n\n", 'end"\nmark', '6" pipe', "cr\r\nlf", '","', ' "spaced" ']
    return [[str(i), rng.choice(values), rng.choice(values)] for i in range(n)]


def written(path, rows, encoding="utf-8", end="\r\n", quoting=csv.QUOTE_MINIMAL, mark=b""):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end, quoting=quoting)
    w.writerows([["k", "a", "b"], *rows])
    path.write_bytes(mark + out.getvalue().encode(encoding))


def got(df):
    return [[v or "" for v in r] for r in df.collect()]


@pytest.mark.parametrize(("encoding", "end", "quoting", "mark"), [("utf-8", "\n", csv.QUOTE_MINIMAL, b""), ("latin-1", "\r\n", csv.QUOTE_MINIMAL, b""), ("utf-8", "\r\n", csv.QUOTE_ALL, b"\xef\xbb\xbf")])
def test_rows_across_ranges(small_ranges, tmp_path, encoding, end, quoting, mark):
    rows = odd_rows(300)
    written(tmp_path / "a.csv", rows, encoding, end, quoting, mark)
    df = split_csv.read(small_ranges, str(tmp_path / "a.csv"))
    assert df.columns == ["k", "a", "b"] and got(df) == rows
    assert split_csv.lines(small_ranges, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20  # partitions grow with the file
    assert readers.read_csv(small_ranges, str(tmp_path / "a.csv")).schema["k"].dataType.simpleString() == "bigint"


def test_one_value_over_many_ranges(small_ranges, tmp_path):
    rows = [["1", "line of thirty characters, so\n" * 100, "z"], ["2", "short", 'q"']]
    written(tmp_path / "a.csv", rows)
    assert got(split_csv.read(small_ranges, str(tmp_path / "a.csv"))) == rows


def test_quotes_inside_values_open_nothing(small_ranges, tmp_path):
    text = 'k,a\n1,6" pipe\n2,"say ""x"""\n\n3,5" and 7"\n4,x"y\n5,"z"\n' * 30
    (tmp_path / "a.csv").write_text(text)
    want = [r for r in csv.reader(io.StringIO(text)) if r][1:]
    df = split_csv.read(small_ranges, str(tmp_path / "a.csv"))
    assert "FileScan csv" in df._jdf.queryExecution().executedPlan().toString()  # no line ends inside a value: the built-in reader
    assert got(df) == want


def test_states_of_lines_against_the_reader():
    rng, q = random.Random(4), split_csv.Quotes(",")
    for _ in range(4000):
        line = "".join(rng.choices('a",', weights=[3, 4, 2], k=rng.randint(0, 12)))
        for state in (0, 1):
            rows = list(csv.reader(io.StringIO(('"' if state else "") + line + "\nmarker\n")))
            assert q.after(line.encode(), state) == (rows[-1] != ["marker"])


def test_folders_headers_and_encodings_by_file(small_ranges, tmp_path):
    a, b = odd_rows(40, 2), [[str(100 + i), "é\nü", "k"] for i in range(40)]
    b[3] = ["k", "a", "b"]  # a row that equals the header
    written(tmp_path / "a.csv", a)
    written(tmp_path / "b.csv", b, "latin-1")
    df = split_csv.read(small_ranges, str(tmp_path))
    assert got(df) == a + b
    assert split_csv.names_of(["x", "", "x", "x.1"]) == ["x", "Unnamed: 1", "x.1", "x.1.1"]
    with pytest.raises(ValueError, match="no file"):
        (tmp_path / "none").mkdir()
        split_csv.read(small_ranges, str(tmp_path / "none"))


def test_files_beyond_the_binary_limit(small_ranges, tmp_path):
    before = small_ranges.conf.get("spark.sql.sources.binaryFile.maxLength")
    small_ranges.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        written(tmp_path / "a.csv", odd_rows(100), "latin-1")
        assert readers.read_table(small_ranges, str(tmp_path / "a.csv")).count() == 100
    finally:
        small_ranges.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_short_and_long_rows_and_utf16(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1\n2,x,more\n\"3\ny\",z\n")
    assert [tuple(r) for r in split_csv.read(spark, str(tmp_path / "a.csv")).collect()] == [("1", None), ("2", "x"), ("3\ny", "z")]
    written(tmp_path / "b.csv", [["1", "é\nx", "y"]], "utf-16")
    assert readers.detect_encoding(spark, str(tmp_path / "b.csv")) == "UTF-16"
    assert got(split_csv.read(spark, str(tmp_path / "b.csv"))) == [["1", "é\nx", "y"]]


def test_semicolon_files_with_line_breaks(small_ranges, tmp_path):
    df = small_ranges.range(200).select(F.col("id").alias("initial_id"), F.concat(F.lit('a;\n"'), "id").alias("t"))
    sinks.write_semicolon(df, str(tmp_path / "s"))
    assert sorted(r.t for r in readers.read_semicolon(small_ranges, str(tmp_path / "s")).collect()) == sorted(f'a;\n"{i}' for i in range(200))


def test_vendor_lines_lose_the_first_line_of_each_file_only(spark, tmp_path):
    (tmp_path / "1.txt").write_text("vendor;families;aliases\nAcme;a;b\nvendor;families;aliases\n")
    (tmp_path / "2.txt").write_text("vendor;families;aliases\nBolt;c\n")
    assert sorted(r.value for r in readers.read_vendor_lines(spark, str(tmp_path)).collect()) == ["Acme;a;b", "Bolt;c", "vendor;families;aliases"]


@pytest.mark.parametrize("value", ["z", "two\nlines"])  # read by the built-in reader, and in ranges
def test_long_values_and_marks_that_end_no_row(spark, tmp_path, value):
    odd = ["\x85", " x", "a\x0bb\x0c", "\x1c", "y" * 300_000]
    rows = [[str(i), v, value] for i, v in enumerate(odd * 3)]
    written(tmp_path / "a.csv", rows, end="\n")
    assert got(split_csv.read(spark, str(tmp_path / "a.csv"))) == rows


@pytest.mark.parametrize("value", ["z", "two\r\nlines", "old\rmark"])
def test_returns_end_rows_outside_of_values(small_ranges, tmp_path, value):
    rows = [[str(i), "x" * (i % 7), value] for i in range(120)]
    for name, end in (("a", "\r"), ("b", "\r\n")):
        written(tmp_path / f"{name}.csv", rows, end=end)
        df = split_csv.read(small_ranges, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["k", "a", "b"] and got(df) == rows
    (tmp_path / "c.csv").write_bytes(b'k,a\r1,"x\ny"\r\n2,u\r3,"v\rw"\n')
    assert got(split_csv.read(small_ranges, str(tmp_path / "c.csv"))) == [["1", "x\ny"], ["2", "u"], ["3", "v\rw"]]


def test_blank_cells_are_null_in_both_ways(spark, tmp_path):
    for name, more in (("a", ""), ("b", 'x;"y\nz";\n')):
        (tmp_path / f"{name}.csv").write_text('a;b;c\n1;"";\n' + more)
        assert tuple(readers.read_semicolon(spark, str(tmp_path / f"{name}.csv")).filter("a = '1'").first()) == ("1", None, None)
