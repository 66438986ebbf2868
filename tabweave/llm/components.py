"""Connected components of a graph held as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import durable, freed
from tabweave.storage import unused, written

#: Edges that one task contracts at a time; a graph of at most so many is done then.
TASK_EDGES = 1_000_000
#: Tasks whose contracted edges are contracted together.
MERGED = 8


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)  # hook the roots, not only the ends
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def stars(batches: Iterator) -> Iterator:
    """Fewer edges (Arrow batches a, b) with the same components, a bounded number at a time."""
    import pyarrow as pa

    kept: list[np.ndarray] = []

    def flush():
        nodes, low = contract(*np.concatenate(kept, 1))
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["a", "b"])

    for batch in batches:
        kept.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        if sum(x.shape[1] for x in kept) >= TASK_EDGES:
            yield flush()
    if kept:
        yield flush()


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task replaces its edges by stars."""
    return edges.mapInArrow(freed(stars), "a long, b long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reached) for every node of an edge.

    Tasks first contract the edges they hold, then those of several tasks together
    as long as this halves them. What is left, if more than ``TASK_EDGES``, is
    settled by rounds of label propagation with pointer jumping: labels are joined
    with edges, never gathered. Self loops are allowed, nulls are not edges.
    """
    pairs = durable(contracted(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()))
    n, before, tasks = pairs.count(), float("inf"), pairs.rdd.getNumPartitions()
    while TASK_EDGES < n <= before / 2 and tasks > 1:
        tasks = -(-tasks // MERGED)
        pairs, before = durable(contracted(pairs.coalesce(tasks))), n
        n = pairs.count()
    if n <= TASK_EDGES:
        return durable(contracted(pairs.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component")))
    both = durable(pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a")).distinct())
    # labels are read again from files, whose size is known: a checkpoint keeps the size that was guessed for its plan, the product of its joins'
    # inputs, so that the guess's digits would double every round, up to numbers of many MB at the driver
    labels = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component").hint("merge"), "other").groupBy("node").agg(F.min("component").alias("m"))
        seen = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = written(seen.join(up.hint("merge"), "component").select("node", "old", F.least("component", "up").alias("component")))
        unused(edges.sparkSession, labels)
        if new.filter("component <> old").limit(1).count() == 0:
            return new.select("node", "component")
        labels = new.select("node", "component")
