"""Reachability, reduction and paths in graphs of any size, as joins; graphs of a table's columns are in ``relations``.

Edges have the columns src and dst. All nodes' reach in a graph without cycles comes level by level: a node's, from that of its
successors, which are settled before it, so that each pair is made once an edge, written once and never compared with what is known. Elsewhere every
round joins only what the last one found with the edges and drops what is known (semi-naive evaluation); rounds are written, so that
plans stay short. Their number is the longest shortest path's length.
Joins are by sort and merge: a written table keeps the size that was guessed for its input, by which edges of any number
would be sent through the driver in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.storage import materialised, written

#: Levels of a graph up to which it is settled level by level; in deeper ones shortest paths may take fewer rounds.
LEVELS = 64


def _merged(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides."""
    return df.hint("merge")


def _levels(e: DataFrame) -> list[DataFrame] | None:
    """The written edges ``e`` by the longest way from a node without predecessors to their source; none if there is a cycle or more than ``LEVELS``."""
    left, out, n = e, [], e.count()
    while n:
        ends = left.select(F.col("dst").alias("src")).distinct()
        inner = written(left.join(_merged(ends), "src", "left_semi"))
        out.append(left.join(_merged(ends), "src", "left_anti"))
        left, n, before = inner, inner.count(), n
        if n == before or (n and len(out) == LEVELS):
            return None
    return out


def _by_levels(levels: list[DataFrame]) -> DataFrame:
    """``closure`` of all nodes, from the last level, whose edges end outside of all, to the first."""
    known = None
    for k, e in enumerate(reversed(levels)):
        found = e.withColumn("steps", F.lit(1))
        if known is not None:
            via = e.withColumnRenamed("dst", "_via").join(_merged(known.withColumnRenamed("src", "_via")), "_via")
            found = found.unionByName(via.select("src", "dst", (F.col("steps") + 1).alias("steps"))).groupBy("src", "dst").agg(F.min("steps").alias("steps"))
        if k < len(levels) - 1:  # of the first level, often half of all, nothing more is made
            found = written(found)
        known = found if known is None else known.unionByName(found)
    return known


def _sources(e: DataFrame, starts: DataFrame) -> DataFrame:
    """src: ``starts`` and every node they reach that has edges."""
    e = e.select("src", "dst")
    known = frontier = written(starts.select("src").distinct())
    while not frontier.isEmpty():
        found = e.join(_merged(frontier), "src", "left_semi").select(F.col("dst").alias("src")).distinct().join(_merged(e.select("src")), "src", "left_semi")
        frontier = written(found.join(_merged(known), "src", "left_anti"))
        known = known.unionByName(frontier)
    return known


def closure(edges: DataFrame, starts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """src, dst, steps: every node that each node (or each of ``starts``, a column src) reaches, and the least number of edges to it.

    A node reaches itself by a cycle only. ``most`` ends the search after so many steps.
    """
    e = written(edges.select("src", "dst").distinct())
    if most is None:
        inside = e
        if starts is not None:
            begun = written(starts.select("src").distinct())
            sources = _sources(e, begun)
            # of many more nodes than were asked for, all nodes' reach would be far larger
            inside = written(e.join(_merged(sources), "src", "left_semi")) if sources.count() <= 2 * begun.count() else None
        levels = None if inside is None else _levels(inside)
        if levels is not None:
            reach = _by_levels(levels) if levels else e.withColumn("steps", F.lit(1)).limit(0)
            return reach if starts is None else reach.join(_merged(begun), "src", "left_semi")
    after = e.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    first = e if starts is None else e.join(_merged(starts.select("src").distinct()), "src", "left_semi")
    frontier = materialised(first.withColumn("steps", F.lit(1)))
    known, rounds = frontier, 1
    while not frontier.isEmpty() and (most is None or rounds < most):
        rounds += 1
        found = frontier.join(_merged(after), "dst").select("src", F.col("_next").alias("dst")).distinct()
        frontier = materialised(found.join(_merged(known.select("src", "dst")), ["src", "dst"], "left_anti").withColumn("steps", F.lit(rounds)))
        known = known.unionByName(frontier)
        if rounds % 8 == 0:
            known = materialised(known)
    return known


def is_acyclic(edges: DataFrame) -> bool:
    """Whether removing nodes without predecessors, round by round, removes all; no closure is needed."""
    left = materialised(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        left = materialised(left.join(_merged(left.select(F.col("dst").alias("src")).distinct()), "src", "left_semi"))
        n, before = left.count(), n
        if n == before:
            return False
    return True


def reduced(edges: DataFrame) -> DataFrame:
    """src, dst of the edges that remain: of edges both ways one, in ascending direction, and of the others the transitive reduction (all, if they have a cycle).

    An edge goes if another successor of its source reaches its target.
    """
    e = materialised(edges.select("src", "dst").distinct())
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = e.join(_merged(back), ["src", "dst"]).filter("src < dst")
    one = materialised(e.join(_merged(back), ["src", "dst"], "left_anti"))
    if not is_acyclic(one):
        return one.unionByName(both)
    # a long way round begins at a node with several successors and ends at one with several predecessors
    forks = one.groupBy("src").count().filter("count > 1").select("src")
    joins = one.groupBy("dst").count().filter("count > 1").select("dst")
    asked = materialised(one.join(_merged(forks), "src", "left_semi").join(_merged(joins), "dst", "left_semi"))
    reach = closure(one, asked.select("src").distinct().join(_merged(one), "src").select(F.col("dst").alias("src")))
    detour = asked.join(_merged(one.select("src", F.col("dst").alias("_via"))), "src").filter("_via <> dst").join(_merged(reach.select(F.col("src").alias("_via"), "dst")), ["_via", "dst"]).select("src", "dst").distinct()
    return one.join(_merged(detour), ["src", "dst"], "left_anti").unionByName(both)


def paths(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """src, dst and path (an array of nodes): for each wanted pair a shortest path along the edges, the first in order of its nodes; pairs without any are left out."""
    e = materialised(edges.select("src", "dst").distinct())
    after = e.select(F.col("src").alias("_at"), F.col("dst").alias("_next"))
    open_ = materialised(wanted.select("src", "dst").distinct())
    frontier = open_.select("src", F.col("src").alias("_at"), F.array("src").alias("path")).distinct()
    seen, out = materialised(frontier.select("src", "_at")), None
    while not open_.isEmpty():
        step = frontier.join(_merged(after), "_at").groupBy("src", F.col("_next").alias("_at")).agg(F.min(F.concat("path", F.array("_next"))).alias("path"))
        # a node that was reached before is passed on by its shorter path; the start may be reached again, by a cycle
        frontier = materialised(step.join(_merged(seen.filter("src <> _at")), ["src", "_at"], "left_anti"))
        if frontier.isEmpty():
            break
        hit = materialised(open_.join(_merged(frontier.withColumnRenamed("_at", "dst")), ["src", "dst"]))
        out = hit if out is None else out.unionByName(hit)
        open_ = materialised(open_.join(_merged(hit), ["src", "dst"], "left_anti"))
        frontier = frontier.filter("src <> _at").join(_merged(open_.select("src").distinct()), "src", "left_semi")
        seen = materialised(seen.unionByName(frontier.select("src", "_at")))
    return out if out is not None else open_.limit(0).withColumn("path", F.array("src"))


def removed(edges: DataFrame) -> DataFrame:
    """src, dst and path: the edges that the reduction drops, and what stands for each: its way round, or the edge itself the other way for one of a mutual pair."""
    e = edges.select("src", "dst").distinct()
    kept = materialised(reduced(e))
    gone = materialised(e.join(_merged(kept), ["src", "dst"], "left_anti"))
    back = gone.join(_merged(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ["src", "dst"])
    ways = paths(kept, gone.join(_merged(back), ["src", "dst"], "left_anti"))
    return ways.unionByName(back.withColumn("path", F.array("dst", "src")))
