"""Hard-negative mining over a vector-approximation file.

Components become integers, floor(scale * x), and a row's score is its integer inner product with the anchor;
higher scores come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of
the same label. For each positive, its negatives are the first ``negatives`` rows of another label whose score s
satisfies ``low * p <= 100 * s <= high * p``, where p is the positive's score.

Each dimension is quantised into ``CELLS`` cells, whose borders come from a bounded sample and whose outermost
ends are the extremes of all rows. The approximation file holds a cell number a dimension, beside the integers. For an
anchor, a table has the largest and the least product of its component with any integer of each cell, so that sums of table entries
bound a row's score. Only rows whose bounds allow them among the best found so far (and into the window of some positive) are scored exactly.

Anchors are taken in blocks of ``ANCHORS`` rows, which are broadcast; each block is held against all rows, once for positives
and once for negatives, without shuffling rows. A task keeps the best of each anchor only, which meet by anchor.

Rows without id, with a null label, or whose vector is null, empty, of another length than most (ties: the
shorter) or holds null or non-finite components take no part. Zero vectors do. Rows that repeat an id are rows of their own, as candidates
and as anchors (each with its own results); rows of the anchor's own id are none of its candidates. Fewer rows than asked for are all returned; an
empty table gives no rows. Components so large that a score may need more than 64 bits raise an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import bounded_batches, durable, freed, regrouped
from tabweave.llm.vector_codes import finite, scaled
from tabweave.storage import numbered, scratch

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Cells a dimension, rows of the sample that sets their borders, and the share of it in each outermost cell.
CELLS, SAMPLE, TAIL = 64, 65_536, 0.004
#: Anchors of a block, anchors whose tables are summed side by side, and rows of a step.
ANCHORS, SIDE, ROWS = 20_000, 64, 2048


class Cells:
    """Borders of the cells of each dimension, and the least and largest integer of each."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray):
        a, b = (np.quantile(sample, q, axis=0) for q in (TAIL, 1 - TAIL))
        inner = a + (b - a) * np.linspace(0, 1, CELLS - 1)[:, None]
        self.borders = np.ceil(inner).astype(np.int64).T.copy()  # dimensions x (cells - 1): the first integer of each cell but the lowest
        self.low = np.concatenate([least[:, None], self.borders], 1)
        self.high = np.concatenate([self.borders - 1, most[:, None]], 1)
        # cells that hold no integer get one that changes no bound
        self.low, self.high = np.minimum(self.low, np.maximum(self.high, least[:, None])), np.maximum(self.high, np.minimum(self.low, most[:, None]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, d], "right") for d, b in enumerate(self.borders)], 1).astype(np.uint8)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """dimensions x cells x anchors: the least and the largest product of a component with an integer of the cell."""
        a = anchors.T[:, None, :]
        x, y = self.low[:, :, None] * a, self.high[:, :, None] * a
        return np.minimum(x, y), np.maximum(x, y)


def bounds(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """rows x anchors sums of table entries."""
    total = np.zeros((len(codes), table.shape[2]), table.dtype)
    part = np.empty_like(total)
    for d in range(table.shape[0]):
        np.take(table[d], codes[:, d], axis=0, out=part)
        total += part
    return total


class Best:
    """The first ``k`` (score, id, label place) of each of ``n`` lists, by falling score and rising id."""

    def __init__(self, n: int, k: int):
        self.k, self.list, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kth = np.full(n, np.iinfo(np.int64).min)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        touched = np.unique(lists)
        at = np.isin(self.list, touched)
        l, s, i = (np.concatenate([a[at], b]) for a, b in ((self.list, lists), (self.score, scores), (self.id, ids)))  # noqa: E741
        order = np.lexsort((i, -s, l))
        l, s, i = l[order], s[order], i[order]  # noqa: E741
        first = np.searchsorted(l, touched)
        rank = np.arange(len(l)) - np.repeat(first, np.diff(np.append(first, len(l))))
        self.kth[l[rank == self.k - 1]] = s[rank == self.k - 1]
        keep = rank < self.k
        self.list, self.score, self.id = (np.concatenate([a[~at], b[keep]]) for a, b in ((self.list, l), (self.score, s), (self.id, i)))


class Block:
    """Anchors of a block, by label, in slices whose tables are summed together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.vectors = ids[self.order], labels[self.order], vectors[self.order]

    def slices(self, by_label: bool):
        cuts = [0, *(np.flatnonzero(np.diff(self.labels)) + 1).tolist(), len(self.labels)] if by_label else [0, len(self.labels)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for s in range(a, b, SIDE):
                yield s, min(b, s + SIDE)


class _Rows:
    """A step's rows by label."""

    def __init__(self, batch):
        read = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)
        labels = batch.column(1).to_numpy()
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = batch.column(0).to_numpy()[order], labels[order]
        self.codes, self.vectors = read(2, np.uint8)[order], read(3, np.int32)[order].astype(np.int64)

    def of(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))


def _tables(cells: Cells, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = cells.tables(anchors)
    small = max(np.abs(low).max(axis=(1, 2)).sum(), np.abs(high).max(axis=(1, 2)).sum()) < 2**30 if low.size else True
    return (low.astype(np.int32), high.astype(np.int32)) if small else (low, high)


def positives_of(rows: _Rows, block: Block, cells: Cells, best: Best) -> int:
    """Adds a step's rows to the best of the same label; returns the number of exact scores."""
    scored = 0
    for a, b in block.slices(by_label=True):
        at = rows.of(int(block.labels[a]))
        codes = rows.codes[at]
        if not len(codes):
            continue
        low, high = _tables(cells, block.vectors[a:b])
        lower, upper = bounds(low, codes), bounds(high, codes)
        own = rows.ids[at][:, None] == block.ids[None, a:b]
        floor = best.kth[a:b].copy()
        if len(codes) > best.k:
            sure = np.where(own, np.iinfo(lower.dtype).min, lower)
            floor = np.maximum(floor, np.partition(sure, len(codes) - best.k, axis=0)[len(codes) - best.k])
        r, q = np.nonzero((upper >= floor) & ~own)
        scored += len(r)
        best.add(q + a, np.einsum("ij,ij->i", rows.vectors[at][r], block.vectors[a + q]), rows.ids[at][r])
    return scored


def negatives_of(rows: _Rows, block: Block, cells: Cells, least: np.ndarray, most: np.ndarray, best: Best) -> int:
    """Adds a step's rows of other labels to the best of each window: anchors x positives ``least`` to ``most``."""
    scored, windows = 0, least.shape[1]
    for a, b in block.slices(by_label=False):
        low, high = _tables(cells, block.vectors[a:b])
        upper = bounds(high, rows.codes).astype(np.int64)
        need = np.maximum(least[a:b], best.kth.reshape(-1, windows)[a:b])
        shut = least[a:b] > most[a:b]  # windows without any integer
        floor = np.where(shut, np.iinfo(np.int64).max, need).min(1)
        r, q = np.nonzero(upper >= floor)
        keep = (rows.labels[r] != block.labels[a + q]) & (rows.ids[r] != block.ids[a + q])
        r, q = r[keep], q[keep]
        if not len(r):
            continue
        lower = low[np.arange(low.shape[0])[None], rows.codes[r], q[:, None]].astype(np.int64).sum(1)
        maybe = (~shut[q] & (upper[r, q][:, None] >= need[q]) & (lower[:, None] <= most[a:b][q])).any(1)
        r, q, scored = r[maybe], q[maybe], scored + int(maybe.sum())
        score = np.einsum("ij,ij->i", rows.vectors[r], block.vectors[a + q])
        k, w = np.nonzero((score[:, None] >= least[a + q]) & (score[:, None] <= most[a + q]) & (score[:, None] >= best.kth.reshape(-1, windows)[a + q]))
        best.add((a + q[k]) * windows + w, score[k], rows.ids[r[k]])
    return scored


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    bounded_batches(spark)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).alias("label"), F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")) & (F.size("vector") > 0))
    if dict(rows.dtypes)["label"] not in ("tinyint", "smallint", "int", "bigint"):  # labels of other kinds by their hash
        rows = rows.withColumn("label", F.xxhash64("label"))
    rows = rows.withColumn("label", F.col("label").cast("long"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    width, total = lengths["n"], lengths["count"]
    rows = rows.filter(F.size("vector") == width)
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    chance = int(min(1.0, 1.2 * SAMPLE / total) * (1 << 40))
    sample = scaled(rows.filter(drawn <= chance).orderBy(drawn, "vec_id", "vector").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks(), width, scale)

    def extremes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        least, most = None, None
        for b in batches:
            x = scaled(b.column(0), width, scale)
            if len(x):
                least, most = (x.min(0), x.max(0)) if least is None else (np.minimum(least, x.min(0)), np.maximum(most, x.max(0)))
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(least), pa.array(most)], names=["d", "least", "most"])

    ends = rows.select("vector").mapInArrow(freed(extremes), "d int, least long, most long").groupBy("d").agg(F.min("least"), F.max("most")).orderBy("d").collect()  # a row a dimension
    least, most = (np.array([e[i] for e in ends], np.int64) for i in (1, 2))
    if max(-int(least.min()), int(most.max())) ** 2 * width >= 2**62:
        raise ValueError(f"scores may need more than 64 bits after scaling by {scale}")
    cells = Cells(sample if len(sample) else np.stack([least, most]), least, most)

    def approximate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in regrouped(batches, ROWS):
            x = scaled(b.column(2), width, scale)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in cells.codes(x)], pa.binary()), pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary()), b.column(3)], names=["vec_id", "label", "codes", "vector", "anchor"])

    folder = scratch(spark, "va-file")
    rows.mapInArrow(freed(approximate), "vec_id long, label long, codes binary, vector binary, anchor boolean").write.parquet(f"{folder}/file")
    file = spark.read.parquet(f"{folder}/file")
    asked = durable(numbered(file.filter("anchor").select("vec_id", "label", "vector"), "n"))
    count = asked.count()
    scan, out = file.select("vec_id", "label", "codes", "vector"), f"{folder}/found"
    top = lambda df, by, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    for start in range(0, count, ANCHORS):
        chosen = asked.filter(F.col("n").between(start, start + ANCHORS - 1)).orderBy("n").toArrow()  # at most ANCHORS rows
        vectors = np.frombuffer(b"".join(chosen.column("vector").to_pylist()), np.int32).reshape(-1, width).astype(np.int64)
        block = Block(chosen.column("vec_id").to_numpy(), chosen.column("label").to_numpy(), vectors)
        shared = spark.sparkContext.broadcast((block, cells))
        found = top(scan.mapInArrow(freed(_positives(shared, positives)), "list long, score long, id long"), "list", positives).select("list", "rank", "score", "id").toArrow()  # ANCHORS x positives rows
        score, ids = np.zeros((len(block.ids), positives), np.int64), np.zeros((len(block.ids), positives), np.int64)
        there = np.zeros((len(block.ids), positives), bool)
        place = found.column("list").to_numpy(), found.column("rank").to_numpy() - 1
        score[place], ids[place], there[place] = found.column("score").to_numpy(), found.column("id").to_numpy(), True
        lowest, highest = np.where(there, -((-low * score) // 100), 1), np.where(there, high * score // 100, 0)
        wanted = spark.sparkContext.broadcast((ids, score, lowest, highest))
        kept = top(scan.mapInArrow(freed(_negatives(shared, wanted, negatives)), "list long, score long, id long, anchor_id long, positive_id long, positive_score long"), "list", negatives)
        kept.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    return spark.read.schema(result).parquet(out) if count else spark.createDataFrame([], result)


def _positives(shared, k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, cells = shared.value
        best = Best(len(block.ids), k)
        for b in regrouped(batches, ROWS):
            positives_of(_Rows(b), block, cells, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.list), pa.array(best.score), pa.array(best.id)], names=["list", "score", "id"])

    return run


def _negatives(shared, wanted, k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        (block, cells), (ids, score, lowest, highest) = shared.value, wanted.value
        best = Best(score.size, k)
        for b in regrouped(batches, ROWS):
            negatives_of(_Rows(b), block, cells, lowest, highest, best)
        anchor, window = np.divmod(best.list, score.shape[1])
        columns = (best.list, best.score, best.id, block.ids[anchor], ids[anchor, window], score[anchor, window])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "score", "id", "anchor_id", "positive_id", "positive_score"])

    return run


def sql(anchors: str = "vec_id % 100 = 0", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, table: str = "embeddings") -> str:
    """The same by brute force, over vectors of one length and ids without repeats."""
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM {table}
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.{anchors}),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives})
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {negatives}"""
