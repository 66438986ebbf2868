"""Readers: CSV with encoding detection, text lines, semicolon files, spreadsheets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.names import col
from tabweave.functions.text import missing_to_null
from tabweave.sources import sheets, split_csv
from tabweave.storage import small_or_not


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-16 by its mark, UTF-8 if every line is valid, else Latin-1 (which accepts any bytes); of several files the least strict."""
    found = set(split_csv.encodings(spark, path).values())
    return next((e for e in (split_csv.UTF16, split_csv.LATIN1) if e in found), split_csv.UTF8)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, sep: str = ",") -> DataFrame:
    """CSV files with headers; usual spellings of missing values are null, types are inferred after that. Files are split, see ``split_csv``."""
    raw = split_csv.read(spark, path, sep, encoding)
    return infer_types(raw.select(*(missing_to_null(col(c)).alias(c) for c in raw.columns)))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become bigint, double or boolean where every present value is one; one aggregate decides."""
    if not df.columns:
        return df
    kinds = {"bigint": lambda c: c.try_cast("bigint").isNotNull() & F.regexp_like(c, F.lit(r"^\s*[+-]?\d+\s*$")), "double": lambda c: c.try_cast("double").isNotNull() & ~F.regexp_like(c, F.lit("(?i)[df]$")), "boolean": lambda c: c.isin("True", "False", "true", "false", "TRUE", "FALSE")}
    tests = [F.coalesce(F.bool_and(F.when(col(c).isNotNull(), t(col(c)))), F.lit(False)).alias(f"t{i}_{k}") for i, c in enumerate(df.columns) for k, t in kinds.items()]
    got = df.agg(*tests).first()
    pick = lambda i: next((k for k in kinds if got[f"t{i}_{k}"]), "string")
    return df.select(*(col(c).try_cast(pick(i)).alias(c) for i, c in enumerate(df.columns)))


def read_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Non-blank trimmed lines, in a column named after the file."""
    return spark.read.text(path).select(F.trim("value").alias(name or PurePosixPath(path).stem)).filter(F.length(col(name or PurePosixPath(path).stem)) > 0)


def read_semicolon(spark: SparkSession, path: str) -> DataFrame:
    """Quoted ``;`` rows, all text; rows without any value are dropped."""
    raw = split_csv.read(spark, path, ";")
    return raw.filter(F.concat_ws("", *(col(c) for c in raw.columns)) != "")


def read_vendor_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of malformed ``;`` files for ``vendors.parse``, without the first line of each file: a later line that equals it stays."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = rows.filter("block = 0").groupBy("file").agg(F.min("at").alias("at"))  # a row a file
    return rows.join(small_or_not(heads), ["file", "at"], "left_anti").select("value")


# --- spreadsheets ------------------------------------------------------------


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of an .xlsx workbook (the first, unless named) with a header row; types are inferred. Rows are read in ranges, see ``sheets``.

    Where only Spark can open the path, the workbook is fetched by Spark and its sheet read as a stream by one task.
    """
    if path.lower().endswith(".xls"):
        raise ValueError("the old .xls format is not supported; save the workbook as .xlsx")
    sheets.register(spark)
    try:
        with sheets.opened(path):
            pass
        reader = spark.read.format("xlsx") if sheet is None else spark.read.format("xlsx").option("sheet", sheet)
        raw = reader.load(path)
    except (OSError, ImportError, ValueError) as e:
        if isinstance(e, ValueError) and "scheme" not in str(e).lower():
            raise
        raw = _fetched(spark, path, sheet)
    return infer_types(raw.select(*(missing_to_null(col(c)).alias(c) for c in raw.columns)))


def _fetched(spark: SparkSession, path: str, sheet: str | None) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    rows = enumerate(sheets.Workbook(z, sheet).rows())
                    while held := list(islice(rows, sheets.BATCH)):
                        yield pd.DataFrame({"row_number": [n for n, _ in held], "cells": [r for _, r in held]})

    cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_number long, cells array<string>")
    header = cells.filter("row_number = 0").first()
    if header is None:
        raise ValueError("the sheet is empty")
    width = cells.agg(F.max(F.size("cells"))).first()[0]
    names = split_csv.names_of([c or "" for c in (*header.cells, *[None] * (width - len(header.cells)))])
    return cells.filter("row_number > 0").orderBy("row_number").select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the file's extension."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".csv":
        return read_csv(spark, path)
    if kind in (".xlsx", ".xls"):
        return read_excel(spark, path)
    if kind == ".txt":
        return read_lines(spark, path)
    raise ValueError(f"unsupported file type: {kind or path}")
