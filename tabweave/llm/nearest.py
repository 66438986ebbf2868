"""Approximate nearest neighbours: a forest of random-projection trees.

Every tree has random orthonormal directions, one per level, and splits each node
at the median of its projection, taken from a bounded sample (``SAMPLE`` rows by a
hash of the id). Every row is placed in one leaf per tree. A query opens leaves of
all trees through one shared priority queue, ordered by the sum of squared margins
of the planes to cross, until the opened leaves hold ``share`` of all rows (at least
``LEAST_ROWS``). Rows of opened leaves are reranked by their exact distance.

The share is measured unless given: for ``TRIALS`` rows of the sample, how far the queue must go for
``RECALL`` of their exact neighbours in the sample. In larger tables neighbours are nearer, so
recall is rather higher there. Uniformly scattered vectors need most rows, clustered ones few.

Leaves are sets of rows of their own; large ones (many copies of a vector) are
salted. Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without id. Ties go to the smaller
id. Rows that repeat an id are one row at their least distance, and as queries give the union of what they find.
Columns of the input other than key, vector and those of ``queries`` are not read. An empty table has no neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import bounded_batches, durable, freed, regrouped

#: Trees, rows that they are fitted on, and rows a leaf; levels follow the table's rows while four rows of the sample are in a leaf.
TREES, SAMPLE, LEAF_ROWS, MOST_LEVELS = 8, 65_536, 200, 14
RECALL, TRIALS, LEAST_ROWS = 0.93, 128, 4000
#: Leaves of a tree that are handled together, and the rows at which such a block is salted.
BLOCK_LEVELS, SALT_ROWS = 3, 20_000
#: Rows whose leaves are found side by side.
ROWS = 2048


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass
class Forest:
    directions: np.ndarray  # trees x dimensions x levels
    cuts: list[list[np.ndarray]]  # trees, levels, nodes of the level

    @property
    def levels(self) -> int:
        return self.directions.shape[2]

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int, seed: int = 11) -> Forest:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        levels = min(levels, dim)
        directions = np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :levels] for _ in range(TREES)])
        cuts = []
        for k in range(TREES):
            at, tree = np.zeros(len(sample), int), []
            for level in range(levels):
                p = sample @ directions[k, :, level]
                cut = np.array([np.median(p[at == v]) if (at == v).any() else 0.0 for v in range(1 << level)])
                tree.append(cut)
                at = 2 * at + (p > cut[at])
            cuts.append(tree)
        return cls(directions, cuts)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees"""
        out = np.zeros((len(x), TREES), np.int64)
        for k in range(TREES):
            p = x @ self.directions[k]
            for level in range(self.levels):
                out[:, k] = 2 * out[:, k] + (p[:, level] > self.cuts[k][level][out[:, k]])
        return out

    def search(self, q: np.ndarray, sizes: dict[tuple[int, int], int], wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold ``wanted`` rows."""
        p = np.einsum("d,kdl->kl", q, self.directions)
        queue, got, out = [(0.0, k, 0, 0) for k in range(TREES)], 0, []
        while queue and got < wanted:
            cost, k, level, node = heapq.heappop(queue)
            if level == self.levels:
                if (k, node) in sizes:
                    got += sizes[k, node]
                    out.append((k, node))
                continue
            margin = p[k, level] - self.cuts[k][level][node]
            near = int(margin > 0)
            heapq.heappush(queue, (cost, k, level + 1, 2 * node + near))
            heapq.heappush(queue, (cost + margin * margin, k, level + 1, 2 * node + 1 - near))
        return out

    def share(self, sample: np.ndarray, k: int) -> float:
        """Rows to open, as a share of all, for ``RECALL`` of the ``k`` nearest neighbours of rows of the sample in it."""
        leaves = self.leaves(sample)
        sizes = {(t, int(leaf)): int(n) for t in range(TREES) for leaf, n in zip(*np.unique(leaves[:, t], return_counts=True), strict=True)}
        needed = []
        for q in range(0, len(sample), -(-len(sample) // TRIALS)):
            d = ((sample - sample[q]) ** 2).sum(1)
            d[q] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            opened, rows = {}, 0
            for at in self.search(sample[q], sizes, np.inf):
                rows += sizes[at]
                opened[at] = rows
            needed += [min(opened[t, int(leaf)] for t, leaf in enumerate(leaves[i])) for i in near]
        return float(np.quantile(needed, RECALL, method="higher")) / len(sample) if needed else 1.0


def _matrix(column, dim: int) -> np.ndarray:
    import pyarrow as pa

    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def neighbours(df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", share: float | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query row's ``k`` nearest found."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("query")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    dim, total = lengths["dim"], lengths["count"]
    rows = rows.filter(F.size("vector") == dim)
    levels = max(1, min(MOST_LEVELS, math.ceil(math.log2(max(2, total / LEAF_ROWS)))))
    place_of = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    chance = int(min(1.0, 1.2 * SAMPLE / total) * (1 << 40))
    sample = _matrix(rows.filter(place_of <= chance).orderBy(place_of, "vec_id", "vector").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks(), dim)
    fitted = Forest.fit(sample, levels)
    forest, share = spark.sparkContext.broadcast(fitted), fitted.share(sample, k) if share is None else share

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = forest.value
        for b in regrouped(batches, ROWS):
            x = _matrix(b.column(1), dim)
            leaves = f.leaves(x)
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaves[:, t]), b.column(0), raw], names=["tree", "leaf", "vec_id", "raw"])

    placed = rows.select("vec_id", "vector").mapInArrow(freed(place), "tree int, leaf long, vec_id long, raw binary").withColumn("block", F.shiftright("leaf", BLOCK_LEVELS))
    counts = durable(placed.groupBy("tree", "block", "leaf").count())  # at most trees * 2^levels rows
    sizes = spark.sparkContext.broadcast({(r.tree, r.leaf): r["count"] for r in counts.collect()})
    salts = F.broadcast(counts.groupBy("tree", "block").agg(F.ceil(F.sum("count") / SALT_ROWS).cast("long").alias("salts")))
    wanted = max(share * total, LEAST_ROWS)

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = forest.value
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            for i, q in zip(ids, x, strict=True):
                found = f.search(q, sizes.value, wanted)
                blocks: dict[tuple[int, int], int] = {}
                for t, leaf in found:  # the opened leaves of a block are bits of one row
                    at = (t, leaf >> BLOCK_LEVELS)
                    blocks[at] = blocks.get(at, 0) | 1 << (leaf & ((1 << BLOCK_LEVELS) - 1))
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t for t, _ in blocks], pa.int32()), "block": pa.array([v for _, v in blocks], pa.int64()), "open": pa.array(list(blocks.values()), pa.int64()), "query_id": pa.array([int(i)] * len(blocks), pa.int64()), "q": pa.array([q.tobytes()] * len(blocks), pa.binary())})

    probes = rows.filter("query").select("vec_id", "vector").mapInArrow(freed(probe), "tree int, block long, open long, query_id long, q binary")
    probes = probes.join(salts, ["tree", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    salted = placed.join(salts, ["tree", "block"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))

    def rerank(left, right):
        import pyarrow as pa

        ids, leaf = left.column("vec_id").to_numpy(), left.column("leaf").to_numpy()
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(ids, kind="stable")
            ids, bit = ids[order], np.left_shift(1, leaf[order] & ((1 << BLOCK_LEVELS) - 1))
            x = np.stack([np.frombuffer(v, float) for v in left.column("raw").to_pylist()])[order]
            for i, bits, q in zip(right.column("query_id").to_pylist(), right.column("open").to_pylist(), right.column("q").to_pylist(), strict=True):
                at = np.flatnonzero((bit & bits).astype(bool) & (ids != i))
                d = np.sqrt(((x[at] - np.frombuffer(q, float)) ** 2).sum(1))
                best = np.argsort(d, kind="stable")[:k]  # rows are in id order, so ties stay so
                out["query_id"] += [i] * len(best)
                out["vec_id"] += ids[at[best]].tolist()
                out["score"] += d[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    group = ("tree", "block", "salt")
    found = salted.select(*group, "leaf", "vec_id", "raw").groupBy(*group).cogroup(probes.select(*group, "open", "query_id", "q").groupBy(*group)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
