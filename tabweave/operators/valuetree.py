"""Trees of conditional value probabilities, grown level by level for all roots at once.

The frontier holds each row's current node; every level unpivots the columns not
yet used, counts values per node and column, and sends the rows of the best
column's most frequent values down. A row has at most one node, so the frontier
never grows. Missing values are the value ``<NA>``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.names import col
from tabweave.functions.text import shown_percent
from tabweave.operators.pairs import ROW_ID
from tabweave.storage import materialised, small_or_not

NA = "<NA>"
MOST_NODES = 100_000


def _text(df: DataFrame) -> DataFrame:
    return df.select(*(F.coalesce(col(c).cast("string"), F.lit(NA)).alias(c) for c in df.columns))


def grouping_score(top_share, distinct):
    """Share of the most frequent value, less for each value beyond two; 0 without values."""
    return F.when(distinct > 0, top_share / (1 + 0.10 * F.greatest(F.lit(0), distinct - 2))).otherwise(0.0)


def trees(df: DataFrame, column: str, values: Sequence[str | None], max_depth: int = 20, min_probability: float = 0.0, max_values: int = 5, remove_determined: bool = False, exclude_id: bool = False) -> DataFrame:
    """node_id, parent_id, root, depth, column, value, count, probability of the trees below ``column = value``."""
    rows = _text(df.drop(ROW_ID) if exclude_id else df)
    names = rows.columns
    roots = [NA if v is None else str(v) for v in values]
    rows = rows.withColumn("_node", col(column)).filter(col(column).isin(roots)).withColumn("_used", F.array(F.lit(column)))
    rows = rows.withColumn("_order", F.col(ROW_ID).cast("long") if ROW_ID in names else F.lit(0))
    start = rows.groupBy(F.col("_node").alias("root")).agg(F.count("*").alias("count"))
    out = start.select(F.col("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "root", F.lit(0).alias("depth"), F.lit(column).alias("column"), F.col("root").alias("value"), "count", F.lit(1.0).alias("probability"))
    frontier = rows.withColumn("_root", F.col("_node"))
    place = F.create_map(*(x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))))
    for depth in range(1, max_depth + 1):
        frontier = materialised(frontier)
        if frontier.isEmpty():
            break
        cells = frontier.select("_node", "_root", "_used", "_order", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in names)))).filter(~F.array_contains("_used", F.col("column")))
        counts = cells.groupBy("_node", "_root", "column", "value").agg(F.count("*").alias("n"), F.min("_order").alias("first"))
        per = counts.groupBy("_node", "column").agg(F.max("n").alias("top"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
        if remove_determined:
            per = per.filter("kinds > 1")
        score = grouping_score(F.col("top") / F.col("total"), F.col("kinds"))
        best = per.groupBy("_node").agg(F.max_by("column", F.struct(score, -F.element_at(place, F.col("column")))).alias("column"), F.max("total").alias("total"))
        rank = F.row_number().over(Window.partitionBy("_node").orderBy(F.desc("n"), "first", "value"))
        chosen = counts.join(best, ["_node", "column"]).withColumn("r", rank).filter(F.col("r") <= max_values).withColumn("probability", F.col("n") / F.col("total")).filter(F.col("probability") >= min_probability)
        level = chosen.select(F.concat_ws("\x1f", "_node", F.concat("column", F.lit("="), "value")).alias("node_id"), F.col("_node").alias("parent_id"), F.col("_root").alias("root"), F.lit(depth).alias("depth"), "column", "value", F.col("n").alias("count"), "probability")
        level = materialised(level)
        out = out.unionByName(level)
        steps = level.select(F.col("parent_id").alias("_node"), F.col("column").alias("_column"), F.col("value").alias("_value"), F.col("node_id").alias("_child"))
        now = F.element_at(F.create_map(*(x for c in names for x in (F.lit(c), col(c)))), F.col("_column"))
        frontier = frontier.join(steps, "_node").filter(now == F.col("_value")).withColumn("_used", F.array_append("_used", F.col("_column"))).withColumn("_node", F.col("_child")).drop("_column", "_value", "_child")
    return out


def top_values(df: DataFrame, column: str, most: int = 15) -> list[str]:
    """The most frequent values, missing included; ties by first appearance, or by value without a row id."""
    key = F.coalesce(col(column).cast("string"), F.lit(NA))
    first = F.min(ROW_ID) if ROW_ID in df.columns else F.lit(0)
    return [r.v for r in df.groupBy(key.alias("v")).agg(F.count("*").alias("n"), first.alias("first")).orderBy(F.desc("n"), "first", "v").limit(most).collect()]


def nested(nodes: DataFrame) -> dict:
    """The node table as nested dicts by root, likeliest values first; for export of at most MOST_NODES nodes."""
    rows = nodes.orderBy("depth", F.desc("probability"), "value").limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError("too many nodes to export at once")
    at = {r.node_id: {"column": r.column, "value": r.value, "count": r["count"], "probability": r.probability, "children": []} for r in rows}
    for r in rows:
        if r.parent_id is not None:
            at[r.parent_id]["children"].append(at[r.node_id])
    return {r.root: at[r.node_id] for r in rows if r.parent_id is None}


def in_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``key``, whose order is depth-first: every node's place among its siblings, likeliest first, from its root down.

    One join a level of children with their parents' keys; no node but the roots' count reaches the driver.
    """
    place = lambda by: F.lpad(F.conv(F.row_number().over(Window.partitionBy(by).orderBy(F.desc("probability"), "value")).cast("string"), 10, 16), 8, "0")
    ranked = materialised(nodes.withColumn("_place", place("parent_id")))  # siblings are values of one node, at most as many as a tree keeps
    deepest = ranked.agg(F.max("depth")).first()[0]
    level = ranked.filter("depth = 0").withColumn("key", F.col("_place"))
    out = level
    for depth in range(1, (deepest or 0) + 1):
        above = level.select(F.col("node_id").alias("parent_id"), F.col("key").alias("_key"))
        level = materialised(ranked.filter(F.col("depth") == depth).join(small_or_not(above), "parent_id").withColumn("key", F.concat("_key", "_place")).select(*ranked.columns, "key"))
        out = out.unionByName(level)
    return out.drop("_place")


def lines(nodes: DataFrame) -> DataFrame:
    """key and line: the text of ``to_text``, a row a node, in depth-first order of the key."""
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), "column", F.lit(" = "), "value", F.lit(" ("), shown_percent(F.col("probability")), F.lit(", "), F.col("count").cast("string"), F.lit(")"))
    return in_order(nodes).select("key", text.alias("line")).orderBy("key")


def write_text(nodes: DataFrame, folder: str) -> None:
    """The tree's lines as text files whose names are in depth-first order; of any number of nodes."""
    lines(nodes).select("line").write.mode("overwrite").text(folder)


def to_json(nodes: DataFrame) -> str:
    return json.dumps(nested(nodes), ensure_ascii=False, indent=2)


def to_text(nodes: DataFrame) -> str:
    lines = []

    def add(node: dict, depth: int) -> None:
        lines.append(f"{'  ' * depth}{node['column']} = {node['value']} ({node['probability']:.2%}, {node['count']})")
        for child in node["children"]:
            add(child, depth + 1)

    for root in nested(nodes).values():
        add(root, 0)
    return "\n".join(lines)
