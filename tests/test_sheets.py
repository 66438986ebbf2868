"""Spreadsheets in ranges of rows, and their memory."""

import tracemalloc
import zipfile

import pytest

from tabweave.sources import readers, sheets


def workbook(path, rows, dimension=True, extra=None):
    shared, at = [], {}

    def cell(v, ref):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            if v not in at:
                at[v] = len(shared)
                shared.append(v)
            return f'<c r="{ref}" t="s"><v>{at[v]}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    body = "".join(f'<row r="{n}">{"".join(cell(v, f"{chr(65 + i)}{n}") for i, v in enumerate(r))}</row>' for n, r in enumerate(rows, 1))
    head = f'<dimension ref="A1:{chr(64 + len(rows[0]))}{len(rows)}"/>' if dimension else ""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}>{head}<sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        for name, text in (extra or {}).items():
            z.writestr(name, text)


ROWS = [["k", "t", "t", None], *([i, f"text {i % 7}" if i % 5 else None, i % 2 == 0, "x"] for i in range(1000))]


@pytest.mark.parametrize("dimension", [True, False])
def test_rows_of_all_ranges(spark, tmp_path, dimension):
    workbook(tmp_path / "a.xlsx", ROWS, dimension)
    sheets.register(spark)
    df = spark.read.format("xlsx").option("rowsPerPartition", 150).load(str(tmp_path / "a.xlsx"))
    assert df.columns == ["k", "t", "t.1", "Unnamed: 3"] and df.rdd.getNumPartitions() == 7
    want = [(str(k), t, str(b), x) for k, t, b, x in ROWS[1:]]
    assert [tuple(r) for r in df.collect()] == want
    typed = readers.read_table(spark, str(tmp_path / "a.xlsx"))
    assert dict(typed.dtypes) == {"k": "bigint", "t": "string", "t.1": "boolean", "Unnamed: 3": "string"} and typed.count() == 1000
    assert spark.read.format("xlsx").option("header", False).load(str(tmp_path / "a.xlsx")).columns == ["c0", "c1", "c2", "c3"]
    assert sorted(r.k for r in readers._fetched(spark, str(tmp_path / "a.xlsx"), None).collect()) == sorted(str(i) for i in range(1000))


def test_sheets_by_name(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    extra = {
        "xl/worksheets/sheet9.xml": f'<worksheet {space}><sheetData><row><c t="inlineStr"><is><t>only</t></is></c></row><row><c><v>5</v></c></row></sheetData></worksheet>',
        "xl/workbook.xml": f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="a"/><sheet name="two" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet9.xml"/></Relationships>',
    }
    workbook(tmp_path / "a.xlsx", ROWS[:3], extra=extra)
    assert readers.read_excel(spark, str(tmp_path / "a.xlsx"), "two").collect() == [(5,)]
    assert readers.read_excel(spark, str(tmp_path / "a.xlsx")).count() == 2
    with pytest.raises(Exception, match="no sheet"):
        readers.read_excel(spark, str(tmp_path / "a.xlsx"), "three")


def test_memory_does_not_grow_with_the_sheet(tmp_path):
    peaks = []
    for n in (3000, 30_000):
        workbook(tmp_path / f"{n}.xlsx", [[i, i + 0.5, "same"] for i in range(n)])
        with sheets.opened(str(tmp_path / f"{n}.xlsx")) as f, zipfile.ZipFile(f) as z:
            book = sheets.Workbook(z)
            tracemalloc.start()
            assert sum(1 for _ in book.rows()) == n == book.extent()[0]
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]
