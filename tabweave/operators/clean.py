"""Cleaning and merging of tables. Decisions are made on aggregates of one scan; rows are never gathered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabweave.functions.names import col, named, quoted
from tabweave.functions.text import as_text, ends_with_space, starts_with_space, strip_to_null
from tabweave.operators.pairs import ROW_ID, columns_of
from tabweave.storage import numbered

MOSTLY = 0.98


def with_row_id(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """``initial_id`` 1..n in the order of the rows; it replaces an existing one. The rows are written once."""
    return numbered(df.drop(ROW_ID), ROW_ID, list(order) if order else None).withColumn(ROW_ID, F.col(ROW_ID) + 1)


def column_profile(df: DataFrame) -> DataFrame:
    """column, rows, nulls, top: the row, null and most frequent value's counts of every column."""
    cols = columns_of(df)
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols))))
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("top"))


def useless_columns(df: DataFrame, limit: float = MOSTLY) -> list[str]:
    """Columns that are nearly all missing, or else nearly constant among present values."""
    found = column_profile(df).filter((F.try_divide("nulls", "rows") > limit) | (F.try_divide(F.col("top"), F.col("rows") - F.col("nulls")) > limit)).select("column").collect()
    bad = {r.column for r in found}
    return [c for c in df.columns if c in bad]


def drop_useless_columns(df: DataFrame, limit: float = MOSTLY) -> DataFrame:
    return df.drop(*useless_columns(df, limit)) if columns_of(df) else df


def drop_empty_rows(df: DataFrame) -> DataFrame:
    cols = columns_of(df)
    return df.dropna("all", subset=[quoted(c) for c in cols]) if cols else df


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name != ROW_ID]


def strip_texts(df: DataFrame) -> DataFrame:
    """Trims every text column; blank texts become null."""
    return df.withColumns({c: strip_to_null(col(c)) for c in _texts(df)}) if _texts(df) else df


def space_counters(df: DataFrame) -> DataFrame:
    """leading, trailing, blanked: values with white space in front or at the end, and blank values."""
    total = lambda test: reduce(lambda a, b: a + b, [F.count_if(test(col(c))) for c in _texts(df)], F.lit(0))
    return df.agg(total(starts_with_space).alias("leading"), total(ends_with_space).alias("trailing"), total(lambda c: c.isNotNull() & strip_to_null(c).isNull()).alias("blanked"))


def drop_duplicates(df: DataFrame, include_id: bool = False) -> DataFrame:
    """Distinct rows, the smallest row id of each staying; with ``include_id`` the id is a value like others."""
    cols = columns_of(df)
    if include_id or ROW_ID not in df.columns:
        return df.dropDuplicates()
    return df.groupBy(*named(cols)).agg(F.min(ROW_ID).alias(ROW_ID)).select(*named(df.columns))


def clean_import(df: DataFrame) -> DataFrame:
    """Sparse and constant columns, then empty rows, then white space, in this order."""
    return strip_texts(drop_empty_rows(drop_useless_columns(df)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a frame lacks are null, and ones of unequal types become text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, k in f.dtypes:
            kinds.setdefault(c, set()).add(k)
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    same = [f.withColumns({c: as_text(col(c), f.schema[c].dataType) for c in f.columns if c in mixed}) if mixed & set(f.columns) else f for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def merge(frames: Sequence[DataFrame], deduplicate: bool = True, trim: bool = True, useless: bool = True) -> DataFrame:
    """Vertical merge: union, duplicates, white space, useless columns, in this order."""
    out = union_all([f.drop(ROW_ID) for f in frames])
    out = out.dropDuplicates() if deduplicate else out
    out = strip_texts(out) if trim else out
    return drop_useless_columns(out) if useless else out


def concat_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Replaces two columns by ``a | b``; missing values print as ``nan``."""
    text = F.concat(as_text(col(a), df.schema[a].dataType, "nan"), F.lit(" | "), as_text(col(b), df.schema[b].dataType, "nan"))
    return df.select(*(col(c) for c in df.columns if c not in (a, b)), text.alias(f"{a} | {b}"))


def with_default(df: DataFrame, column: str, value: object = "") -> DataFrame:
    """``df`` with a constant column, unless it has one of that name."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def label_encoded(df: DataFrame, column: str) -> DataFrame:
    """The column's values replaced by 0, 1, ... in ascending order; missing stays missing. Only distinct values are sorted."""
    values = df.select(col(column).alias("_v")).filter("_v IS NOT NULL").distinct()
    codes = numbered(values, "_code", ["_v"])
    return df.join(codes, col(column) == F.col("_v"), "left").withColumn(column, F.col("_code")).select(*named(df.columns))


def report_counts(df: DataFrame, result: str, group: str | None = None) -> DataFrame:
    """rows, filled (rows with a non-blank result) and, by group, groups and average rows per group (0 for no rows)."""
    filled = F.count_if(strip_to_null(col(result).cast("string")).isNotNull()).alias("filled")
    if group is None:
        return df.agg(F.count("*").alias("rows"), filled)
    out = df.groupBy(col(group)).agg(F.count("*").alias("rows"), filled)
    known = col(group).isNotNull()
    average = F.coalesce(F.try_divide(F.sum(F.when(known, F.col("rows"))), F.count_if(known)), F.lit(0.0))
    return out.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"), F.count_if(known).alias("groups"), average.alias("rows_per_group"))
