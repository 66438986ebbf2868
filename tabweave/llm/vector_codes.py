"""Vector code compression: product quantisation by Yinyang Lloyd rounds in integers.

Components become integers, floor(scale * x), and vectors are cut into equal parts, each with a codebook
of its own. A round assigns every part to the nearest entry (squared distance, ties to the lower
index) and moves entries to the floored means of their parts; unused entries stay.

Entries of a codebook are clustered into groups once. A part keeps its entry, an upper bound of the distance to it and
one lower bound a group of the distance to the group's other entries. When entries move, the bounds follow by the length of
the move (of the longest in the group); a group is scanned only if its bound may not exceed the upper bound,
and scans compare squared distances in integers, so that ties are those of the plain method. Bounds are kept
in single precision, rounded to the safe side.

Bounds travel with the rows: each round's rows are written in the shared folder, and only sums and counts of
entries (parts x entries rows) reach the driver.

Vectors that are null, empty, of another length than most (ties: the shorter), or hold null or non-finite components take no part.
Rows without id are compressed too, but come after all ids when entries are chosen; rows that repeat an id
are rows of their own, those with smaller vectors first. A table of fewer rows than entries has so many entries; an empty one gives no rows.
Components beyond 2**27 in size after scaling, and lengths that the parts don't divide, raise an error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import bounded_batches, durable, freed, regrouped, small_or_not

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries a group, rows handled side by side, and the largest component, so that squared distances and their sums are exact.
GROUP, SIDE, MOST = 4, 4096, 1 << 27
_UP, _DOWN = np.float32(1 + 2**-20), np.float32(1 - 2**-20)


def finite(vector: Column) -> Column:
    """Whether a vector is there, with finite components only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(column, width: int, scale: int) -> np.ndarray:
    """rows x width integers floor(scale * x) of an Arrow list column."""
    import pyarrow as pa

    x = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale).reshape(-1, width)
    if x.size and np.abs(x).max() > MOST:
        raise ValueError(f"a vector has a component beyond {MOST} after scaling by {scale}")
    return x.astype(np.int64)


@dataclass
class Codebooks:
    entries: np.ndarray  # parts x entries x width
    groups: np.ndarray  # parts x entries: the group of each entry

    @classmethod
    def start(cls, vectors: np.ndarray, parts: int, size: int = GROUP) -> Codebooks:
        """Codebooks of the rows' own parts; entries are grouped by a few rounds of their own."""
        entries = vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2)
        count, groups = max(1, -(-len(vectors) // size)), []
        for e in entries.astype(float):
            centres = e[np.linspace(0, len(e) - 1, count).astype(int)]
            for _ in range(5):
                near = ((e[:, None] - centres) ** 2).sum(2).argmin(1)
                centres = np.stack([e[near == g].mean(0) if (near == g).any() else centres[g] for g in range(count)])
            groups.append(near)
        return cls(entries, np.stack(groups))

    @property
    def count(self) -> int:
        return int(self.groups.max()) + 1 if self.groups.size else 0

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries at the floored means of ``sums`` (part, entry -> count, sums of components)."""
        entries = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            entries[part, entry] = [t // n for t in total]
        return Codebooks(entries, self.groups)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def assign_all(x: np.ndarray, entries: np.ndarray, groups: np.ndarray, count: int):
    """Entry, upper bound and lower bound a group of each part, from all distances."""
    d = _squares(x, entries)
    code, at = d.argmin(1), np.arange(len(x))  # argmin takes the first of equals
    far = np.sqrt(d)
    upper = (far[at, code] * _UP).astype(np.float32)
    far[at, code] = np.inf
    lower = np.full((len(x), count), np.inf, np.float32)
    for g in range(count):
        if (groups == g).any():
            lower[:, g] = far[:, groups == g].min(1) * _DOWN
    return code.astype(np.uint8), upper, lower


def assign_again(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, groups: np.ndarray) -> int:
    """Updates entries and bounds in place after the entries moved; returns the number of distances taken."""
    drift = np.sqrt(((new - old).astype(float) ** 2).sum(1))
    count = lower.shape[1]
    longest = np.array([drift[groups == g].max() if (groups == g).any() else 0.0 for g in range(count)])
    upper[:] = (upper + drift[code]) * _UP
    np.maximum((lower - longest * _UP) * np.where(lower > longest, _DOWN, _UP), 0, out=lower, casting="unsafe")
    open_ = np.flatnonzero(upper >= lower.min(1))
    if not len(open_):
        return 0
    mine = ((x[open_] - new[code[open_]]) ** 2).sum(1)  # the bound is tightened first
    upper[open_] = np.sqrt(mine) * _UP
    taken = len(open_)
    keep = upper[open_] >= lower[open_].min(1)
    open_, mine = open_[keep], mine[keep]
    if not len(open_):
        return taken
    before = code[open_].astype(np.int64)
    best, best_d = before.copy(), mine.copy()
    scan = upper[open_, None] >= lower[open_]
    scanned = []
    for g in range(count):
        members = np.flatnonzero(groups == g)
        rows = np.flatnonzero(scan[:, g])
        if not len(rows) or not len(members):
            continue
        d = _squares(x[open_[rows]], new[members])
        taken += d.size
        scanned.append((g, members, rows, d))
        k = d.argmin(1)
        low, entry = d[np.arange(len(rows)), k], members[k]
        wins = (low < best_d[rows]) | ((low == best_d[rows]) & (entry < best[rows]))
        best[rows[wins]], best_d[rows[wins]] = entry[wins], low[wins]
    for g, members, rows, d in scanned:  # lower bounds of scanned groups leave out the entry that was chosen
        far = np.where(members[None] == best[rows, None], np.inf, np.sqrt(d))
        lower[open_[rows], g] = far.min(1) * _DOWN
    changed = np.flatnonzero(best != before)  # the entry given up is one of its group's others now
    g = groups[before[changed]]
    lower[open_[changed], g] = np.minimum(lower[open_[changed], g], np.sqrt(mine[changed]) * _DOWN)
    code[open_], upper[open_] = best, np.sqrt(best_d) * _UP
    return taken


_STATE = "vec_id long, label {label}, vector binary, code binary, upper binary, lower binary"


@dataclass
class Compressed:
    """Codebooks, and rows of vec_id, label, code (a byte a part), error: the squared distance summed over parts."""

    codebooks: Codebooks | None
    rows: DataFrame
    distances: list[int]  # that each round took after the first


def _arrays(batch, width: int, parts: int, count: int):
    import pyarrow as pa

    get = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind)
    n = batch.num_rows
    return pa, get(2, np.int32).reshape(n, parts, width).astype(np.int64), get(3, np.uint8).reshape(n, parts).copy(), get(4, np.float32).reshape(n, parts).copy(), get(5, np.float32).reshape(n, parts, count).copy()


def _packed(pa, x: np.ndarray):
    return pa.array([r.tobytes() for r in x], pa.binary())


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    spark = df.sparkSession
    bounded_batches(spark)
    kind = dict(df.dtypes)[label]
    state, result = _STATE.format(label=kind), f"vec_id long, label {kind}, code binary, error long"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(finite(F.col("vector")) & (F.size("vector") > 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return Compressed(None, spark.createDataFrame([], result), [])
    if lengths["n"] % parts:
        raise ValueError(f"vectors of {lengths['n']} components can't be cut into {parts} equal parts")
    width = lengths["n"] // parts
    rows = rows.filter(F.size("vector") == lengths["n"])
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow().column(0).combine_chunks()
    books = [Codebooks.start(scaled(first, width * parts, scale), parts)]
    count = books[0].count

    def begin(batches: Iterator) -> Iterator:
        import pyarrow as pa

        book = books[0]
        for b in regrouped(batches, SIDE):
            x = scaled(b.column(2), width * parts, scale).reshape(b.num_rows, parts, width)
            found = [assign_all(x[:, p], book.entries[p], book.groups[p], count) for p in range(parts)]
            code, upper, lower = (np.stack(a, axis=1) for a in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(pa, x.astype(np.int32)), _packed(pa, code), _packed(pa, upper), _packed(pa, lower)], names=_names(state))

    def step(old: Codebooks, new: Codebooks):
        def run(batches: Iterator) -> Iterator:
            for b in regrouped(batches, SIDE):
                pa, x, code, upper, lower = _arrays(b, width, parts, count)
                taken = 0
                for p in range(parts):
                    c, u, w = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    taken += assign_again(x[:, p], c, u, w, old.entries[p], new.entries[p], new.groups[p])
                    code[:, p], upper[:, p], lower[:, p] = c, u, w
                n = np.zeros(b.num_rows, np.int64)
                n[0] = taken
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _packed(pa, code), _packed(pa, upper), _packed(pa, lower), pa.array(n)], names=[*_names(state), "taken"])

        return run

    def sums(batches: Iterator) -> Iterator:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in regrouped(batches, SIDE):
            pa, x, code, _, _ = _arrays(b, width, parts, count)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                n[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), *(pa.array(total[part, entry, i]) for i in range(width))], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    distances = []
    placed = durable(rows.mapInArrow(freed(begin), state))
    for r in range(rounds):
        partial = placed.drop("taken").mapInArrow(freed(sums), f"part int, entry int, n long, {', '.join(f's{i} long' for i in range(width))}")
        # sums of longs over all rows may need more than 64 bits
        totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
        moved = books[-1].moved({(t["part"], t["entry"]): (t["n"], [int(t[f"s{i}"]) for i in range(width)]) for t in totals.collect()})  # parts x entries rows
        placed = durable(placed.drop("taken").mapInArrow(freed(step(books[-1], moved)), f"{state}, taken long"))
        distances.append(placed.agg(F.sum("taken")).first()[0])
        books.append(moved)
    last = books[-1]

    def finish(batches: Iterator) -> Iterator:
        for b in regrouped(batches, SIDE):
            pa, x, code, _, _ = _arrays(b, width, parts, count)
            error = ((x - last.entries[np.arange(parts)[None], code]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(error)], names=_names(result))

    return Compressed(last, placed.drop("taken").mapInArrow(freed(finish), result), distances)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def decoded(codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """rows x components integers that ``codes`` (rows x parts) stand for."""
    return books.entries[np.arange(books.entries.shape[0])[None], codes].reshape(len(codes), -1)


def report(found: Compressed) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors of equal labels summed, nulls together), codebooks_sha256."""
    rows = durable(found.rows)
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_tw_label")
    digest = F.lit(found.codebooks.digest() if found.codebooks else None).cast("string")
    out = rows.join(small_or_not(by_label), F.col("label").eqNullSafe(F.col("_tw_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, table: str = "embeddings") -> str:
    """The same by plain Lloyd rounds, over vectors of one length and ids without repeats."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM {table}
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, j, e[j * len(e) // {parts} + 1 : (j + 1) * len(e) // {parts}] AS q FROM v, range({parts}) t(j))",
        f"b0 AS MATERIALIZED (SELECT j, k, q AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT {entries}) f USING (vec_id))",
    ]
    d = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, j, q, x.k AS k, x.d AS d FROM (SELECT vec_id, j, any_value(q) AS q, min({{'d': {d}, 'k': k}}) AS x FROM p JOIN b{r} USING (j) GROUP BY vec_id, j))")
        if r < rounds:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT j, k, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN
                (SELECT j, k, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS c FROM (SELECT j, k, i, sum(q[i]) AS s, count(*) AS n FROM (SELECT j, k, q, unnest(range(1, len(q) + 1)) AS i FROM a{r}) GROUP BY j, k, i) GROUP BY j, k) m USING (j, k))"""
            )
    return f"""WITH {", ".join(steps)},
        o AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(x, ',' ORDER BY j, k)) AS codebooks_sha256 FROM (SELECT j, k, array_to_string(c, ',') AS x FROM b{rounds}))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h"""
