"""Relationships between columns, for all pairs in one scan.

One GROUPING SETS query counts every pair's value combinations; scores, samples
and repairs derive from these counts, which are far smaller than the rows. The
smallest row id of each combination settles ties by first appearance. A null of
the data differs from one of the grouping by the grouping id.

A scan multiplies rows by its pairs, so pairs that can't reach a threshold are ruled out before. In a bounded sample
of rows, those whose child has two parents are invalid in the whole table too; their share may exceed the true one by
``MARGIN`` with odds below 1e-16 (Hoeffding). Of the rest, distinct counts of columns and pairs are estimated by mergeable sketches in one pass:
values that have more parents than one make so many rows invalid at least. Pairs that remain are counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.names import col, named
from tabweave.storage import materialised

ROW_ID = "initial_id"
#: Pairs of one scan; the expansion multiplies rows by their number.
SETS_PER_SCAN = 40
#: Rows of the sample (at least so many for a verdict), by how much its shares may err, bits of sketches, and their standard errors allowed for.
SAMPLE, LEAST_SAMPLE, MARGIN, SKETCH_BITS, ERRORS = 65_536, 20_000, 0.03, 12, 6


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def require(df: DataFrame, *names: str) -> None:
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")


def without_missing(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(col(a).isNotNull() & col(b).isNotNull())


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """col1, col2, v1, v2 (as strings), n, first: the occurrences of each value pair, nulls included."""
    require(df, *{c for p in pairs for c in p})
    out = None
    for at in range(0, len(pairs), SETS_PER_SCAN):
        chunk = list(pairs[at : at + SETS_PER_SCAN])
        cols = list(dict.fromkeys(c for p in chunk for c in p))
        typed = df.select(*(col(c).cast("string").alias(f"k{i}") for i, c in enumerate(cols)), F.col(ROW_ID))
        names = [f"k{i}" for i in range(len(cols))]
        sets = [[F.col(f"k{cols.index(a)}"), F.col(f"k{cols.index(b)}")] for a, b in chunk]
        grouped = typed.groupingSets(sets, *names).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.min(ROW_ID).alias("first"))

        def gid(a: str, b: str, cols=cols) -> int:
            return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in (a, b))

        ids = [(gid(a, b), a, b) for a, b in chunk]
        pick = lambda side: F.coalesce(*(F.when(F.col("gid") == g, F.col(f"k{cols.index((a, b)[side])}")) for g, a, b in ids))  # noqa: E731, B023
        name = lambda side: F.coalesce(*(F.when(F.col("gid") == g, F.lit((a, b)[side])) for g, a, b in ids))  # noqa: E731, B023
        part = grouped.select(name(0).alias("col1"), name(1).alias("col2"), pick(0).alias("v1"), pick(1).alias("v2"), "n", "first")
        out = part if out is None else out.unionByName(part)
    return out


def directed(counts: DataFrame) -> DataFrame:
    """parent, child, pv, cv, n, first: both directions of unordered pair counts, each row read once."""
    side = lambda a, b: F.struct(col(f"col{a}").alias("parent"), col(f"col{b}").alias("child"), col(f"v{a}").alias("pv"), col(f"v{b}").alias("cv"), "n", "first")
    return counts.select(F.inline(F.array(side(1, 2), side(2, 1))))


def _percent(valid: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(valid.cast("double"), total) * 100, F.lit(0.0))


def violation(percentage: Column) -> Column:
    return F.when(percentage > 0, 1 - percentage / 100).otherwise(1.0)


def one_to_many(edges: DataFrame, drop_na: bool = True) -> DataFrame:
    """Per (parent, child): total, valid, percentage, violation_ratio, distinct and missing counts, from ``directed`` counts.

    A row is valid if its child value is present and has exactly one distinct
    parent value; a child whose parents are all missing is not valid. One aggregate by
    child value and one by pair; a parent's distinct values are those of the opposite direction's child.
    """
    used = F.col("pv").isNotNull() & F.col("cv").isNotNull() if drop_na else F.lit(True)
    per_child = edges.groupBy("parent", "child", "cv").agg(
        F.sum(F.when(used, F.col("n")).otherwise(0)).alias("n"), F.count("pv").alias("parents"), F.sum("n").alias("all"),
        F.sum(F.when(F.col("pv").isNull(), F.col("n")).otherwise(0)).alias("na_parent"),
    )
    good = F.when(F.col("cv").isNotNull() & (F.col("parents") == 1), F.col("n")).otherwise(0)
    score = per_child.groupBy("parent", "child").agg(
        F.sum(good).alias("valid"), F.sum("n").alias("total"), F.count("cv").alias("distinct_child"), F.sum("na_parent").alias("na_parent"),
        F.sum(F.when(F.col("cv").isNull(), F.col("all")).otherwise(0)).alias("na_child"),
    )
    both = Window.partitionBy(F.least("parent", "child"), F.greatest("parent", "child"))  # a pair's two directions
    pct = _percent(F.col("valid"), F.col("total"))
    out = score.withColumn("distinct_parent", F.sum("distinct_child").over(both) - F.col("distinct_child"))
    return out.select("parent", "child", "valid", "total", pct.alias("percentage"), violation(pct).alias("violation_ratio"), "distinct_parent", "distinct_child", "na_parent", "na_child")


def one_to_one(counts: DataFrame, drop_na: bool = True) -> DataFrame:
    """Per unordered pair: valid rows are those whose values have exactly one partner each.

    If every present value has one partner, all rows count, those with missing
    values too. Partners are counted by value and joined back, so that no value's partners meet in one task.
    """
    first, second = F.col("v1").isNotNull(), F.col("v2").isNotNull()
    used = (first & second) if drop_na else F.lit(True)
    partners = lambda v, w, name: counts.filter(col(v).isNotNull()).groupBy("col1", "col2", v).agg(F.count(w).alias(name))
    rows = counts.join(partners("v1", "v2", "p1"), ["col1", "col2", "v1"], "left").join(partners("v2", "v1", "p2"), ["col1", "col2", "v2"], "left")
    add = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    fits = (~first | (F.col("p1") == 1)) & (~second | (F.col("p2") == 1))
    score = rows.groupBy("col1", "col2").agg(
        F.coalesce(F.bool_and(F.when(used, fits)), F.lit(True)).alias("all"), add(first & second & fits).alias("some"), add(used).alias("total"), add(~first).alias("na1"), add(~second).alias("na2"),
    )
    distinct = lambda v, w, name: partners(v, w, "_p").groupBy("col1", "col2").agg(F.count("*").alias(name))
    keys = ["col1", "col2"]
    out = score.join(distinct("v1", "v2", "distinct1"), keys, "left").join(distinct("v2", "v1", "distinct2"), keys, "left").fillna(0, ["distinct1", "distinct2"])  # a row a pair
    out = out.withColumn("valid", F.when(F.col("all"), F.col("total")).otherwise(F.col("some")))
    return out.select("col1", "col2", "valid", "total", _percent(F.col("valid"), F.col("total")).alias("percentage"), "distinct1", "distinct2", "na1", "na2")


def _sampled_out(df: DataFrame, pairs: list[tuple[str, str]], share: float, drop_na: bool, both: bool) -> set[tuple[str, str]]:
    """Pairs whose share of valid rows a bounded sample proves to be below ``share``, for either direction (or for the exact partners, if ``both``)."""
    drawn = F.pmod(F.xxhash64(F.col(ROW_ID)), F.lit(1 << 40))
    chance = int(min(1.0, 1.2 * SAMPLE / df.count()) * (1 << 40))
    sample = materialised(df.filter(drawn <= chance).orderBy(drawn, ROW_ID).limit(SAMPLE).select(ROW_ID, *named(dict.fromkeys(c for p in pairs for c in p))))
    counts = materialised(pair_counts(sample, pairs))
    first, second = F.col("v1").isNotNull(), F.col("v2").isNotNull()
    used = (first & second) if drop_na else F.lit(True)
    partners = lambda v, w, name: counts.filter(col(v).isNotNull()).groupBy("col1", "col2", v).agg(F.count(w).alias(name))
    rows = counts.filter(used).join(partners("v1", "v2", "p1"), ["col1", "col2", "v1"], "left").join(partners("v2", "v1", "p2"), ["col1", "col2", "v2"], "left")
    many1, many2 = F.coalesce(F.col("p1") > 1, F.lit(False)), F.coalesce(F.col("p2") > 1, F.lit(False))
    add = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    found = rows.groupBy("col1", "col2").agg(F.sum("n").alias("n"), F.max(many1 | many2).alias("any"), add(~first | many1).alias("bad1"), add(~second | many2).alias("bad2"), add(~first | ~second | many1 | many2).alias("bad")).collect()  # a row a pair
    out = set()
    for r in found:
        if r.n < LEAST_SAMPLE:
            continue
        lost = lambda bad: 1 - bad / r.n + MARGIN < share  # noqa: E731, B023
        if (r.any and lost(r.bad)) if both else (lost(r.bad1) and lost(r.bad2)):
            out.add((r.col1, r.col2))
    return out


def _sketched_out(df: DataFrame, pairs: list[tuple[str, str]], share: float, drop_na: bool, both: bool) -> set[tuple[str, str]]:
    """Pairs with so many more value pairs than values that too many rows must be invalid; one pass of mergeable sketches."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    present = lambda a, b: col(a).isNotNull() & col(b).isNotNull()
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(SKETCH_BITS)))
    text = lambda c: col(c).cast("string")
    one = df.agg(
        F.count("*").alias("n"), *(sketch(F.xxhash64(text(c))).alias(f"d{i}") for i, c in enumerate(cols)),
        *(x for k, (a, b) in enumerate(pairs) for x in (sketch(F.when(present(a, b), F.xxhash64(text(a), text(b)))).alias(f"p{k}"), F.count_if(present(a, b)).alias(f"n{k}"))),
    ).first()
    error = ERRORS * 1.04 / math.sqrt(1 << SKETCH_BITS)
    out = set()
    for k, (a, b) in enumerate(pairs):
        total = one[f"n{k}"] if drop_na else one.n
        beyond = [(one[f"p{k}"] or 0) * (1 - error) - (one[f"d{cols.index(c)}"] or 0) * (1 + error) for c in (a, b)]
        lost = [total > 0 and (total - x) / total < share for x in beyond]
        if any(lost) if both else all(lost):
            out.add((a, b))
    return out


def may_reach(df: DataFrame, pairs: Sequence[tuple[str, str]], threshold: float, drop_na: bool = True, both: bool = False) -> list[tuple[str, str]]:
    """The unordered pairs of which a direction (the exact partners, if ``both``) may reach the threshold in percent; all pairs of
    a table that the sample would hold whole, since counting them is no dearer."""
    share, left = threshold / 100, list(pairs)
    if df.limit(2 * SAMPLE).count() < 2 * SAMPLE:
        return left
    for rule in (_sampled_out, _sketched_out):
        if left and share > 0:
            gone = rule(df, left, share, drop_na, both)
            left = [p for p in left if p not in gone]
    return left


def _counted(df: DataFrame, columns: Sequence[str], threshold: float, drop_na: bool, prune: bool, both: bool = False) -> DataFrame:
    """Exact counts of the pairs that may reach the threshold, written once; of all pairs without pruning."""
    pairs = list(combinations(columns, 2))
    left = may_reach(df, pairs, threshold, drop_na, both) if prune else pairs
    return materialised(pair_counts(df, left)) if left else pair_counts(df.limit(0), pairs[:1])


def above(results: DataFrame, percent: float) -> DataFrame:
    """Results whose percentage reaches a threshold given in percent."""
    return results.filter(F.col("percentage") >= (percent / 100) * 100)


def _ranked(results: DataFrame, by: Column, columns: Sequence[str], a: str, b: str) -> DataFrame:
    """Highest first; ties in the order of the columns."""
    place = F.array(*map(F.lit, columns))
    return results.orderBy(by.desc(), F.array_position(place, col(a)), F.array_position(place, col(b)))


def analyse_one_to_many(df: DataFrame, threshold: float = 95, drop_na: bool = True, columns: Sequence[str] | None = None, prune: bool = True) -> DataFrame:
    """Results of all ordered pairs that reach the threshold, highest percentage first; ``prune`` spares scans of pairs that can't."""
    columns = list(columns or columns_of(df))
    found = one_to_many(directed(_counted(df, columns, threshold, drop_na, prune and len(columns) > 2)), drop_na)
    return _ranked(above(found, threshold), F.col("percentage"), columns, "parent", "child")


def analyse_one_to_one(df: DataFrame, threshold: float = 95, drop_na: bool = True, columns: Sequence[str] | None = None, prune: bool = True) -> DataFrame:
    """Results of all unordered pairs that reach the threshold, highest percentage first; ``prune`` spares scans of pairs that can't."""
    columns = list(columns or columns_of(df))
    found = one_to_one(_counted(df, columns, threshold, drop_na, prune and len(columns) > 2, both=True), drop_na)
    return _ranked(above(found, threshold), F.col("percentage"), columns, "col1", "col2")


def analyse_errors(df: DataFrame, drop_na: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Results of ordered pairs with violations, highest violation ratio first."""
    columns = list(columns or columns_of(df))
    found = one_to_many(directed(pair_counts(df, list(combinations(columns, 2)))), drop_na)
    return _ranked(found.filter("valid < total"), F.col("violation_ratio"), columns, "parent", "child")


def ordered_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(permutations(columns, 2))


def row_mask(df: DataFrame, parent: str, child: str) -> DataFrame:
    """The rows with ``valid``; by a join with the per-child counts, so that a common child is pre-aggregated."""
    counts = df.groupBy(col(child), col(parent)).agg(F.count("*").alias("n")).groupBy(col(child)).agg(F.count(col(parent)).alias("_parents"))
    return df.join(counts.filter(col(child).isNotNull()), child, "left").withColumn("valid", F.coalesce(F.col("_parents") == 1, F.lit(False))).drop("_parents")


def samples(df: DataFrame, parent: str, child: str, valid: bool = True, most: int | None = 1000) -> DataFrame:
    """Occurrences of value pairs among the first ``most`` valid (or invalid) rows; pairs with a missing value are left out."""
    rows = row_mask(df, parent, child).filter(F.col("valid") == valid)
    rows = rows if most is None else rows.orderBy(ROW_ID).limit(most)
    return without_missing(rows, parent, child).groupBy(col(parent), col(child)).agg(F.count("*").alias("occurrences"), F.min(ROW_ID).alias("first")).orderBy(F.desc("occurrences"), "first")


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls, rows, share: from one aggregate over all columns."""
    cols = columns_of(df)
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)))
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col("rows")) for i, c in enumerate(cols)))
    return one.select(F.inline(items)).withColumn("share", F.coalesce(F.try_divide("nulls", "rows"), F.lit(0.0)))


def value_frequencies(df: DataFrame, column: str, with_missing: bool = False) -> DataFrame:
    """value, n, first; most frequent first, ties by first appearance."""
    rows = df if with_missing else df.filter(col(column).isNotNull())
    return rows.groupBy(col(column).alias("value")).agg(F.count("*").alias("n"), F.min(ROW_ID).alias("first")).orderBy(F.desc("n"), "first")


def categorical(df: DataFrame) -> DataFrame:
    """column, kind, categorical: text columns with few distinct values are categorical."""
    kinds = dict(df.dtypes)
    cols = columns_of(df)
    one = df.agg(*(F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)), *(F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(cols)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(f"n{i}").alias("present"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(cols)))
    few = (F.col("distinct_values") < 0.5 * F.col("present")) | (F.col("distinct_values") < 100)
    return one.select(F.inline(rows)).withColumn("categorical", (F.col("kind") == "string") & (F.col("present") > 0) & few)
