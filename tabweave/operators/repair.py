"""Repair of one-to-many violations by majority vote, gated by confidence."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.names import col
from tabweave.operators.pairs import ROW_ID, above, columns_of, directed, one_to_many, pair_counts, require
from tabweave.storage import materialised, small_or_not

#: Least share in percent of the majority, by number of present parents.
CONFIDENCE = ((100, 60), (50, 65), (20, 70), (10, 75), (5, 80))
OTHERWISE = 85


def needed_percent(total: Column) -> Column:
    out = F.lit(OTHERWISE)
    for least, percent in reversed(CONFIDENCE):
        out = F.when(total >= least, percent).otherwise(out)
    return out


def confident(total: Column, top: Column, second: Column, min_count: int = 5, ratio: float = 3.0) -> Column:
    share = F.try_divide(top, total) * 100 >= needed_percent(total)
    return F.coalesce((total >= min_count) & share & ((second == 0) | (top / second >= ratio)), F.lit(False))


def plans(edges: DataFrame, drop_na: bool = True, min_count: int = 5, ratio: float = 3.0) -> DataFrame:
    """One row per (parent, child) pair and violating child value.

    correct_value is the most frequent parent value, the first seen on ties;
    num_changes counts the child's rows that differ from it, missing parents
    included, and present the rows that have a parent. The second count comes from a join of the counts with the most frequent
    values of violating children: no child's parents are ranked in one task.
    """
    keys = ["parent", "child", "cv"]
    used = edges.filter("cv IS NOT NULL" + (" AND pv IS NOT NULL" if drop_na else ""))
    best = F.max(F.when(F.col("pv").isNotNull(), F.struct("n", -F.col("first"), "pv")))
    per_child = used.groupBy(*keys).agg(F.count("pv").alias("parents"), best.alias("best"), F.sum("n").alias("rows"), F.sum(F.when(F.col("pv").isNotNull(), F.col("n")).otherwise(0)).alias("present"), F.min("first").alias("first"))
    bad = materialised(per_child.filter("parents > 1").select(*keys, "parents", F.col("best.pv").alias("correct_value"), F.col("best.n").alias("top"), "rows", "present", "first"))
    others = used.join(small_or_not(bad.select(*keys, "correct_value")), keys).filter(F.col("pv").isNotNull() & (F.col("pv") != F.col("correct_value")))
    second = others.groupBy(*keys).agg(F.max("n").alias("second"))
    return bad.join(second, keys).select(*keys, "correct_value", "parents", "present", "top", "second", (F.col("rows") - F.col("top")).alias("num_changes"), confident(F.col("present"), F.col("top"), F.col("second"), min_count, ratio).alias("confident"), "first")


def plan_for_pair(df: DataFrame, parent: str, child: str, drop_na: bool = True, min_count: int = 5, ratio: float = 3.0) -> DataFrame:
    require(df, parent, child)
    edges = directed(pair_counts(df, [(parent, child)])).filter(F.col("parent") == parent)
    return plans(edges, drop_na, min_count, ratio)


def preview(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per violating child value and current parent value."""
    now = edges.filter("pv IS NOT NULL AND cv IS NOT NULL").select("parent", "child", "cv", F.col("pv").alias("current_value"), F.col("n").alias("occurrences"))
    return now.join(plan.select("parent", "child", "cv", "correct_value", "confident"), ["parent", "child", "cv"]).withColumn("changes", F.col("current_value") != F.col("correct_value")).orderBy("parent", "child", "cv", F.desc("occurrences"), "current_value")


def totals(plan: DataFrame) -> DataFrame:
    """Per pair: corrections and changes, confident and not."""
    sure = F.col("confident")
    return plan.groupBy("parent", "child").agg(
        F.count("*").alias("corrections"), F.sum("num_changes").alias("changes"), F.count_if(sure).alias("confident_corrections"), F.sum(F.when(sure, F.col("num_changes")).otherwise(0)).alias("confident_changes"),
        F.count_if(~sure).alias("unsure_corrections"), F.sum(F.when(~sure, F.col("num_changes")).otherwise(0)).alias("unsure_changes"),
    )


def cells(df: DataFrame, plan: DataFrame, parent: str, child: str, order: int = 0, confident_only: bool = False, drop_na: bool = True) -> DataFrame:
    """plan_order, column, initial_id, new_value: the cells that a pair's plan changes."""
    todo = plan.filter((F.col("parent") == parent) & (F.col("child") == child) & (F.lit(not confident_only) | F.col("confident"))).select("cv", "correct_value")
    rows = df.filter(col(parent).isNotNull()) if drop_na else df
    hit = rows.select(ROW_ID, col(child).cast("string").alias("cv"), col(parent).cast("string").alias("old")).join(todo, "cv").filter(~F.col("old").eqNullSafe(F.col("correct_value")))
    return hit.select(F.lit(order).alias("plan_order"), F.lit(parent).alias("column"), ROW_ID, F.col("old").alias("old_value"), F.col("correct_value").alias("new_value"))


def all_plans(df: DataFrame, threshold: float = 95, drop_na: bool = True, columns: Sequence[str] | None = None, min_count: int = 5, ratio: float = 3.0) -> DataFrame:
    """plan_order (from 0) and the plans of every ordered pair with errors whose percentage reaches the threshold.

    Counts of all pairs come from the scans of ``pair_counts``, written once; plans all refer to this one state of the
    table. Pairs are in the order of the results: most violations first, ties in the order of the columns.
    """
    columns = list(columns or columns_of(df))
    edges = materialised(directed(pair_counts(df, list(combinations(columns, 2)))))
    place = F.array(*map(F.lit, columns))
    found = above(one_to_many(edges, drop_na), threshold).filter("valid < total").select("parent", "child", "violation_ratio")
    order = Window.orderBy(F.desc("violation_ratio"), F.array_position(place, F.col("parent")), F.array_position(place, F.col("child")))
    pairs = found.select("parent", "child", (F.row_number().over(order) - 1).alias("plan_order"))  # a row a pair of columns
    return plans(edges, drop_na, min_count, ratio).join(F.broadcast(pairs), ["parent", "child"])


def all_cells(df: DataFrame, plan: DataFrame, confident_only: bool = False, drop_na: bool = True) -> DataFrame:
    """The cells that the plans of all pairs change (see ``cells``), from one pass over the rows.

    A row meets the plans of all its child values in one join: it is unpivoted to (child, value), as plans are keyed.
    """
    todo = plan.filter("confident") if confident_only else plan
    by_value = todo.groupBy("child", "cv").agg(F.collect_list(F.struct("plan_order", "parent", "correct_value")).alias("plans"))  # as many as pairs at most
    kids = [r.child for r in todo.select("child").distinct().collect()]  # names of columns
    parents = [r.parent for r in todo.select("parent").distinct().collect()]
    if not kids:
        return df.select(F.lit(0).alias("plan_order"), F.lit("").alias("column"), ROW_ID, F.lit("").alias("old_value"), F.lit("").alias("new_value")).limit(0)
    now = F.create_map(*(x for c in parents for x in (F.lit(c), col(c).cast("string"))))
    long = df.select(ROW_ID, now.alias("now"), F.inline(F.array(*(F.struct(F.lit(c).alias("child"), col(c).cast("string").alias("cv")) for c in kids)))).filter("cv IS NOT NULL")
    hit = long.join(small_or_not(by_value), ["child", "cv"]).select(ROW_ID, "now", F.inline("plans")).withColumn("old_value", F.element_at("now", F.col("parent")))
    hit = hit.filter(~F.col("old_value").eqNullSafe(F.col("correct_value")) & (F.col("old_value").isNotNull() | F.lit(not drop_na)))
    return hit.select("plan_order", F.col("parent").alias("column"), ROW_ID, "old_value", F.col("correct_value").alias("new_value"))


def repair_all(df: DataFrame, threshold: float = 95, drop_na: bool = True, columns: Sequence[str] | None = None, confident_only: bool = False, min_count: int = 5, ratio: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(the table after all plans in order, the changed cells with the plan that changes each): later plans win a cell, and both writes count."""
    changes = materialised(all_cells(df, all_plans(df, threshold, drop_na, columns, min_count, ratio), confident_only, drop_na))
    return apply(df, changes), changes


def apply(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Writes the cells; of several plans for one cell the last wins. Rows that are gone are left alone."""
    last = changes.groupBy(ROW_ID, "column").agg(F.max_by("new_value", "plan_order").alias("new"))
    columns = [c for c in df.columns if c != ROW_ID]
    wide = last.groupBy(ROW_ID).agg(*(F.max(F.when(F.col("column") == c, F.col("new"))).alias(f"_new_{c}") for c in columns))
    kinds = dict(df.dtypes)
    return df.join(wide, ROW_ID, "left").select(*(F.coalesce(col(f"_new_{c}").try_cast(kinds[c]), col(c)).alias(c) if c in columns else col(c) for c in df.columns))
