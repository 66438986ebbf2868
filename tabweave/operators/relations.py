"""The graph of one-to-many relations between columns.

Its nodes are a table's columns, so graph searches run on the driver, over at
most ``MOST_EDGES`` edges; statistics and colours are DataFrame operations.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.colors import of_missing, of_violations

MOST_EDGES = 1_000_000
Edge = tuple[str, str]


def edges_of(results: DataFrame, columns: Iterable[str]) -> DataFrame:
    """src (parent), dst (child), violation_ratio of relations whose columns still exist."""
    have = list(columns)
    return results.filter(F.col("parent").isin(have) & F.col("child").isin(have)).select(F.col("parent").alias("src"), F.col("child").alias("dst"), "violation_ratio")


def _edges(edges: DataFrame | Iterable[Edge]) -> list[Edge]:
    if isinstance(edges, DataFrame):
        got = edges.select("src", "dst").limit(MOST_EDGES + 1).collect()
        if len(got) > MOST_EDGES:
            raise ValueError("too many edges for a graph of columns")
        edges = [(r.src, r.dst) for r in got]
    return list(dict.fromkeys(edges))


def _after(edges: Iterable[Edge]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    return out


def _reach(after: dict[str, set[str]], start: str) -> set[str]:
    seen, todo = set(), deque(after.get(start, ()))
    while todo:
        x = todo.popleft()
        if x not in seen:
            seen.add(x)
            todo.extend(after[x])
    return seen


def is_acyclic(edges: DataFrame | Iterable[Edge]) -> bool:
    after = _after(_edges(edges))
    return not any(x in _reach(after, x) for x in after)


def mutual(edges: DataFrame) -> DataFrame:
    """src, dst: pairs with edges both ways, once, in alphabetical direction."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").join(back, ["src", "dst"]).filter("src < dst").distinct()


def reduced(edges: DataFrame | Iterable[Edge]) -> list[Edge]:
    """Edges that remain: mutual pairs once, and of the others the transitive reduction; all of the others if they have a cycle."""
    all_edges = _edges(edges)
    have = set(all_edges)
    both = sorted({(min(e), max(e)) for e in have if (e[1], e[0]) in have and e[0] != e[1]})
    one_way = [e for e in all_edges if (e[1], e[0]) not in have]
    after = _after(one_way)
    reach = {x: _reach(after, x) for x in after}
    if any(x in r for x, r in reach.items()):
        return [*one_way, *both]
    return [*((a, b) for a, b in one_way if not any(b in reach[w] for w in after[a] if w != b)), *both]


def removed(edges: DataFrame | Iterable[Edge]) -> list[Edge]:
    kept = set(reduced(edges))
    return [e for e in _edges(edges) if e not in kept]


def shortest_path(edges: DataFrame | Iterable[Edge], start: str, end: str) -> list[str] | None:
    """Explains a removed edge by the path that replaces it."""
    after, came, todo = _after(_edges(edges)), {start: None}, deque([start])
    while todo:
        x = todo.popleft()
        if x == end:
            path = [x]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            return path[::-1]
        for y in sorted(after.get(x, ())):
            if y not in came:
                came[y] = x
                todo.append(y)
    return None


def node_statistics(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, root, leaf, successors, predecessors."""
    e = edges.select("src", "dst").distinct()
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"), F.array_sort(F.collect_set("dst")).alias("successors"))
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"), F.array_sort(F.collect_set("src")).alias("predecessors"))
    none = F.array().cast("array<string>")
    out = outs.join(ins, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("successors", none).alias("successors"), F.coalesce("predecessors", none).alias("predecessors"))
    return out.withColumn("root", F.col("in_degree") == 0).withColumn("leaf", F.col("out_degree") == 0)


def graph_statistics(edges: DataFrame) -> DataFrame:
    """nodes, edges, acyclic, roots, leaves, and nodes with more than one parent or child."""
    s = node_statistics(edges).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"), F.count_if("root").alias("roots"), F.count_if("leaf").alias("leaves"), F.count_if(F.col("in_degree") > 1).alias("many_parents"), F.count_if(F.col("out_degree") > 1).alias("many_children"))
    return s.withColumn("acyclic", F.lit(is_acyclic(edges)))


def colored_edges(edges: DataFrame) -> DataFrame:
    ratio = F.coalesce("violation_ratio", F.lit(0.0))
    return edges.withColumn("color", of_violations(ratio))


def colored_nodes(nodes: DataFrame, profile: DataFrame) -> DataFrame:
    """node, share, color: by the share of missing values in the null profile; 0 if unknown."""
    got = nodes.join(profile.select(F.col("column").alias("node"), "share"), "node", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return got.select("node", "share", of_missing(F.col("share")).alias("color"))


def to_dot(edges: DataFrame) -> str:
    """The coloured graph as text for a drawing program."""
    rows = colored_edges(edges).orderBy("src", "dst").limit(MOST_EDGES).collect()
    return "\n".join(["digraph {", *(f'  "{r.src}" -> "{r.dst}" [color="{r.color}"];' for r in rows), "}"])
