"""Spreadsheets (.xlsx) as a data source: ``spark.read.format("xlsx").load(path)``.

A sheet's rows are dealt in ranges over tasks. Every task reads its workbook as a stream, row by row, and lets each row go once it is
passed, so that memory depends on one row, the table of shared texts and a batch, not on the sheet. All columns are text;
missing cells are null; the first row names the columns (``header`` false: c0, c1, ...). ``sheet`` picks a sheet by name, else the
first of the workbook is read. Paths are local or shared folders' files, or what the Arrow file systems open (``s3://``, ``hdfs://``, ``gs://``).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Fixed value: day 0 of dates. Rows a partition and a batch hold.
EPOCH, ROWS, BATCH = datetime(1899, 12, 30), 50_000, 2000


@contextmanager
def opened(path: str) -> Iterator[io.IOBase]:
    """A file that can be read from any place."""
    kind = urlparse(path).scheme
    if kind in ("", "file"):
        with open(unquote(urlparse(path).path) if kind else path, "rb") as f:
            yield f
    else:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_file(at) as f:
            yield f


def _place(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Each element of a kind, read as a stream; it and what lies before it are let go afterwards."""
    with z.open(name) as f:
        events = ElementTree.iterparse(f, ("start", "end"))
        root = next(events)[1]
        above = [root]
        for event, e in events:
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == tag:
                yield e
                e.clear()
                above[-1].remove(e)


class Workbook:
    def __init__(self, z: zipfile.ZipFile, sheet: str | None = None):
        self.z, names = z, set(z.namelist())
        self.sheet = self._file(names, sheet)
        self.shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in _elements(z, "xl/sharedStrings.xml", f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._dates() if "xl/styles.xml" in names else frozenset()

    def _file(self, names: set[str], wanted: str | None) -> str:
        """The file of the sheet of that name, or of the one that the workbook lists first."""
        if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
            for sheet in ElementTree.fromstring(self.z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
                if wanted in (None, sheet.get("name")):
                    own = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
                    for r in ElementTree.fromstring(self.z.read("xl/_rels/workbook.xml.rels")):
                        if r.get("Id") == own:
                            target = r.get("Target", "")
                            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if wanted is not None:
            raise ValueError(f"no sheet of the name {wanted}")
        return min((n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n))

    def _dates(self) -> frozenset[int]:
        styles = ElementTree.fromstring(self.z.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")): f.get("formatCode", "").lower() for f in styles.iter(f"{_MAIN}numFmt")}
        cells = styles.find(f"{_MAIN}cellXfs")
        kinds = [int(x.get("numFmtId", 0)) for x in (cells if cells is not None else ())]
        return frozenset(i for i, k in enumerate(kinds) if 14 <= k <= 22 or any(c in custom.get(k, "") for c in ("yy", "dd", "h:mm")))

    def _text(self, c: ElementTree.Element) -> str | None:
        v, kind = c.find(f"{_MAIN}v"), c.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        return str(EPOCH + timedelta(days=float(v.text))) if int(c.get("s", -1)) in self.dates else v.text

    def rows(self, start: int = 0, end: int | None = None) -> Iterator[list[str | None]]:
        """Cells of the sheet's rows from ``start`` to before ``end``, counted as they come."""
        for n, row in enumerate(_elements(self.z, self.sheet, f"{_MAIN}row")):
            if end is not None and n >= end:
                return
            if n >= start:
                out: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _place(c.get("r", "")) if c.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    out[at] = self._text(c)
                yield out

    def extent(self) -> tuple[int, int]:
        """The sheet's rows and columns as its own head states them, or counted."""
        with self.z.open(self.sheet) as f:
            for _, e in ElementTree.iterparse(f, ("start",)):
                if e.tag == f"{_MAIN}dimension":
                    last = e.get("ref", "").partition(":")[2]
                    digits = "".join(c for c in last if c.isdigit())
                    if digits:
                        return int(digits), _place(last) + 1
                if e.tag == f"{_MAIN}sheetData":
                    break
        rows = width = 0
        for row in self.rows():
            rows, width = rows + 1, max(width, len(row))
        return rows, width


@dataclass
class _Range(InputPartition):
    start: int
    end: int | None


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.sheet = schema.names, options["path"], options.get("sheet")
        self.first = int(options.get("header", "true").lower() == "true")
        self.step = int(options.get("rowsperpartition", ROWS))

    def partitions(self) -> list[_Range]:
        with opened(self.path) as f, zipfile.ZipFile(f) as z:
            size, _ = Workbook(z, self.sheet).extent()
        starts = list(range(self.first, max(size, self.first + 1), self.step))
        return [_Range(a, None if k == len(starts) - 1 else a + self.step) for k, a in enumerate(starts)]  # the last reads on to the end

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in range(len(self.names))], names=self.names)

        with opened(self.path) as f, zipfile.ZipFile(f) as z:
            held: list = []
            for row in Workbook(z, self.sheet).rows(partition.start, partition.end):
                held.append(row)
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)


class Sheets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        from tabweave.sources.split_csv import names_of

        with opened(self.options["path"]) as f, zipfile.ZipFile(f) as z:
            book = Workbook(z, self.options.get("sheet"))
            first = next(book.rows(), None)
            if first is None:
                raise ValueError("the sheet is empty")
            first += [None] * (book.extent()[1] - len(first))
        header = self.options.get("header", "true").lower() == "true"
        return StructType([StructField(n, StringType()) for n in (names_of([c or "" for c in first]) if header else [f"c{i}" for i in range(len(first))])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Sheets)
