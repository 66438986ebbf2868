"""CSV files whose quoted values may hold line breaks, read by many tasks.

A file's ranges are read as lines. Whether a line starts inside a quoted value depends on all lines before it, but only by
that one bit: every range says in which state it ends for either state that it may start in, and these few answers,
taken in the order of the file, give each range its true state. A quote opens a value only where a value begins, as usual
readers take it, so that an inch mark inside a value does no harm. Rows end at ``\n``, ``\r\n`` or ``\r`` outside of quoted
values and at no other mark; values may have any length.

If no line ends inside a value, every line is a row, and the built-in reader does the rest. Otherwise ranges give the rows that
begin and end in them, and pieces of those that cross their borders; pieces meet by the row they belong to.
"""

from __future__ import annotations

import csv
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UTF8, LATIN1, UTF16 = "UTF-8", "ISO-8859-1", "UTF-16"
#: The marks that UTF-16 files begin with, and the one that UTF-8 files may begin with.
MARKS_16, MARK_8 = (b"\xff\xfe", b"\xfe\xff"), b"\xef\xbb\xbf"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the range's first byte), at (rising within a range) and the bytes of each line, without its ``\n``."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))


def encodings(spark: SparkSession, path: str) -> dict[str, str]:
    """Each file's encoding: UTF-16 by its mark, UTF-8 if every line is valid, else Latin-1 (which accepts any bytes)."""
    rows = lines(spark, path)
    begin = F.min_by(F.substring("value", 1, 2), F.struct("block", "at"))
    found = rows.groupBy("file").agg(begin.alias("begin"), F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("valid")).collect()  # a row a file
    return {r.file: UTF16 if bytes(r.begin) in MARKS_16 else UTF8 if r.valid else LATIN1 for r in found}


def ended(line: bytes) -> list[tuple[bytes, bytes]]:
    """The parts of a line that end at a ``\r`` or at its end, each with what ends it."""
    end = b"\r\n" if line.endswith(b"\r") else b"\n"
    parts = line.removesuffix(b"\r").split(b"\r")
    return [*((p, b"\r") for p in parts[:-1]), (parts[-1], end)]


class Quotes:
    """How a line changes the state: inside a quoted value (1) or not (0)."""

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        body = rb'[^"]*+(?:""[^"]*+)*+'
        self.opens = re.compile(rb"(?:(?:\"" + body + rb"\"[^" + s + rb"]*+|[^\"" + s + rb"][^" + s + rb"]*+|)" + s + rb")*+\"" + body + rb"\Z")
        self.closes = re.compile(body + rb"\"[^" + s + rb"]*+(" + s + rb"|\Z)")

    def after(self, line: bytes, state: int) -> int:
        if b'"' not in line:
            return state
        at = 0
        if state:
            end = self.closes.match(line)
            if end is None:
                return 1
            if not end[1]:
                return 0
            at = end.end()
        return int(self.opens.match(line, at) is not None)


def range_states(rows: DataFrame, sep: str) -> list:
    """A row for each range that has lines with quotes: its end for a start outside and inside, and whether any of its lines, read from outside, ends inside."""
    quotes = Quotes(sep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, ends, breaks = None, [0, 1], False
        out: list[tuple] = []
        for b in batches:
            for file, block, line in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != now:
                    if now is not None:
                        out.append((*now, *ends, breaks))
                    now, ends, breaks = (file, block), [0, 1], False
                for part, _ in ended(line):
                    breaks = breaks or quotes.after(part, 0) == 1
                    ends = [quotes.after(part, s) for s in ends]
        if now is not None:
            out.append((*now, *ends, breaks))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["file", "block", "outside", "inside", "breaks"])

    quoted = rows.filter(F.contains(F.col("value"), F.lit(b'"')))
    return quoted.select("file", "block", "value").mapInArrow(run, "file string, block long, outside int, inside int, breaks boolean").collect()


def starts(states: list) -> dict[tuple[str, int], int]:
    """The ranges that start inside a value, by file and first byte; ranges without quotes keep the state and need no entry of their own."""
    inside, state, file = {}, 0, None
    for r in sorted(states, key=lambda r: (r.file, r.block)):
        if r.file != file:
            file, state = r.file, 0
        inside[r.file, r.block] = state
        state = r.inside if state else r.outside
    return inside


@dataclass
class Layout:
    """What the tasks need of a file: its separator, the states of ranges at their starts and ends, and its encoding."""

    sep: str
    begin: dict[tuple[str, int], int]
    after: dict[str, list[tuple[int, int]]]  # of each file, (first byte, state at the end) of ranges with quotes, in order
    encodings: dict[str, str]

    @classmethod
    def of(cls, states: list, sep: str, encodings: dict[str, str]) -> Layout:
        begin, after = starts(states), {}
        for r in sorted(states, key=lambda r: (r.file, r.block)):
            after.setdefault(r.file, []).append((r.block, r.inside if begin[r.file, r.block] else r.outside))
        return cls(sep, begin, after, encodings)

    def start(self, file: str, block: int) -> int:
        ends = self.after.get(file, [])
        i = bisect_left(ends, (block, -1))
        return ends[i - 1][1] if i else 0

    def cells(self, record: str) -> list[str]:
        csv.field_size_limit(sys.maxsize)
        return next(csv.reader([record], delimiter=self.sep), [])  # its line ends are all inside values

    def decode(self, file: str, record: bytes) -> str:
        return record.removeprefix(MARK_8).decode("latin-1" if self.encodings.get(file) == LATIN1 else "utf-8")


_SPLIT = "file string, block long, seq long, kind string, top boolean, cells array<string>, piece binary"


def _split(layout: Layout):
    """Rows of each range, and the pieces of rows that cross its borders: ``head`` ends one, ``tail`` begins one, ``middle`` does neither."""
    quotes = Quotes(layout.sep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, state, seq, held, begun, out = None, 0, 0, [], False, []

        def emit(kind: str | None = None) -> None:
            nonlocal seq, held, begun
            last = held[-1][1] if kind is None else b"\n"  # what the next range begins with follows a line's end
            record, top = b"".join(p + e for p, e in held).removesuffix(last), now[1] == 0 and seq == 0
            held = []
            if kind is None and begun:
                text = layout.decode(now[0], record)
                if not text.strip():
                    return
                out.append((*now, seq, "row", top, layout.cells(text), None))
            else:
                out.append((*now, seq, kind or "head", top, None, record))
            seq, begun = seq + 1, True

        def batch():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SPLIT.split(", ")])

        for b in batches:
            for file, block, line in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != now:
                    if held:
                        emit("tail" if begun else "middle")
                    now, state, seq, held = (file, block), layout.start(file, block), 0, []
                    begun = not state
                for part in ended(line):
                    held.append(part)
                    state = quotes.after(part[0], state)
                    if not state:
                        emit()
            if out:
                yield batch()
                out = []
        if held:
            emit("tail" if begun else "middle")
        if out:
            yield batch()

    return run


def _joined(pieces: DataFrame, layout: Layout) -> DataFrame:
    """Rows from pieces: a tail opens one, middles and a head follow. Only pieces meet here, two a range at most."""
    order = Window.partitionBy("file").orderBy("block", "seq")
    grouped = pieces.withColumn("row", F.sum((F.col("kind") == "tail").cast("long")).over(order))

    @F.pandas_udf("array<string>")
    def cells(file, parts):
        import pandas as pd

        return pd.Series([layout.cells(layout.decode(f, b"\n".join(p))) for f, p in zip(file, parts, strict=True)])

    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "piece"))), lambda p: p.piece)
    rows = grouped.groupBy("file", "row").agg(F.min(F.struct("block", "seq", "top")).alias("first"), parts.alias("parts"))
    return rows.select("file", "first.block", "first.seq", "first.top", cells("file", "parts").alias("cells"))


def names_of(header: list[str]) -> list[str]:
    """Column names: blank ones by their place, repeated ones numbered."""
    out: list[str] = []
    for i, name in enumerate(header):
        name, k = name or f"Unnamed: {i}", 0
        while (shown := f"{name}.{k}" if k else name) in out:
            k += 1
        out.append(shown)
    return out


def read(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> DataFrame:
    """All columns as text, in the order of the files; every file's first row is its header, the first file's names the columns.

    Blank lines are left out; blank cells are null, short rows are filled with nulls, and what a row has beyond the header is dropped.
    """
    rows = lines(spark, path)
    found = encodings(spark, path) if encoding is None else dict.fromkeys((r.file for r in rows.select("file").distinct().collect()), encoding)
    if not found:
        raise ValueError(f"no file with lines: {path}")
    kinds = set(found.values())
    if UTF16 in kinds:
        if len(kinds) > 1:
            raise ValueError("UTF-16 files can't be read together with others")
        # its line breaks are no single bytes, so that a file is one task's work
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", UTF16).option("sep", sep).csv(path)
    states = range_states(rows, sep)
    layout = Layout.of(states, sep, found)
    if len(kinds) == 1 and not any(r.breaks for r in states):
        first = rows.filter(F.col("file") == min(found)).filter("block = 0 AND trim(BOTH '\r \t' FROM cast(value AS STRING)) <> ''").orderBy("at").first()
        names = names_of(layout.cells(layout.decode(first.file, next(p for p, _ in ended(bytes(first.value)) if p.strip()))))
        reader = spark.read.schema(", ".join(f"`{n.replace('`', '``')}` string" for n in names)).option("header", True).option("escape", '"').option("sep", sep)
        return reader.option("encoding", kinds.pop()).option("enforceSchema", True).csv(path)
    split = rows.select("file", "block", "value").mapInArrow(_split(layout), _SPLIT)
    whole = split.filter("kind = 'row'").select("file", "block", "seq", "top", "cells").unionByName(_joined(split.filter("kind <> 'row'"), layout))
    header = whole.filter("top").orderBy("file").first()
    body = whole.filter("NOT top").orderBy("file", "block", "seq")
    return body.select(*(F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names_of(header.cells))))
