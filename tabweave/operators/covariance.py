"""Covariance of mixed columns, with feature clustering.

Everything over rows is one Spark aggregate; only matrices with one row per
column (or per category) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabweave.functions.names import col, named, quoted
from tabweave.operators.impute import is_numeric
from tabweave.operators.pairs import ROW_ID, categorical, pair_counts
from tabweave.storage import materialised, small_or_not, unused, written

MISSING = "_MISSING_"
#: Categories up to which their table is a matrix on the driver, and rounds of iteration beyond.
MOST_CATEGORIES, ROUNDS = 2000, 200
#: Iteration ends when no eigenvalue moves by more than this share of the largest.
TOLERANCE = 1e-9


def classify(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, skipped) columns."""
    few = {r.column for r in categorical(df.select(ROW_ID, *named(columns))).filter("categorical").collect()}
    numbers = [c for c in columns if is_numeric(df, c)]
    texts = [c for c in columns if c in few and isinstance(df.schema[c].dataType, StringType)]
    return numbers, texts, [c for c in columns if c not in numbers and c not in texts]


def zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column becomes zeros."""
    cast = {c: col(c).cast("double") for c in columns}
    s = df.agg(*(F.avg(cast[c]).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(cast[c]).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return df.withColumns({c: (cast[c] - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def frequency_encoding(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each value's share of rows; missing is a value. Counts are joined back, so a hot value is pre-aggregated."""
    total = df.count()
    for c in columns:
        key = F.coalesce(col(c), F.lit(MISSING))
        shares = df.groupBy(key.alias("_k")).agg((F.count("*") / F.lit(max(total, 1))).alias("_share"))
        df = df.withColumn("_k", key).join(small_or_not(shares), "_k").drop("_k", c).withColumnRenamed("_share", c)
    return df


def category_scores(df: DataFrame, columns: Sequence[str], components: int | None = None) -> tuple[DataFrame, np.ndarray, float]:
    """(c, v, scores as an array; inertias; total inertia) of multiple correspondence analysis, from the table of pair counts.

    Up to MOST_CATEGORIES categories the table is a matrix on the driver; beyond, its leading vectors
    come from orthogonal iteration, in which only sums over all categories reach the driver.
    """
    filled = df.select(ROW_ID, *(F.coalesce(col(c), F.lit(MISSING)).alias(c) for c in columns))
    singles = materialised(filled.select(F.inline(F.array(*(F.struct(F.lit(c).alias("c"), col(c).alias("v")) for c in columns)))).groupBy("c", "v").agg(F.count("*").alias("n")))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    counts = pair_counts(filled, pairs) if pairs else None
    kinds = singles.count()
    k, rows = components or min(10, max(1, kinds - len(columns))), singles.agg(F.sum("n")).first()[0] / len(columns) if kinds else 0
    found, values = (_by_matrix if kinds <= MOST_CATEGORIES else _by_iteration)(singles, counts, len(columns), k, rows)
    return found, values, kinds / len(columns) - 1


def _by_matrix(singles: DataFrame, counts: DataFrame | None, columns: int, k: int, rows: float) -> tuple[DataFrame, np.ndarray]:
    numbered_ = singles.select("c", "v", "n", (F.row_number().over(Window.orderBy("c", "v")) - 1).alias("i"))  # at most MOST_CATEGORIES rows
    own = materialised(numbered_).orderBy("i").toArrow()
    cats = list(zip(own.column("c").to_pylist(), own.column("v").to_pylist(), strict=True))
    at = {c: i for i, c in enumerate(cats)}
    burt = np.diag(own.column("n").to_numpy().astype(float))
    if counts is not None:  # three numbers a pair of categories, as arrays
        place = F.broadcast(singles.sparkSession.createDataFrame([(*c, i) for c, i in at.items()], "c string, v string, i long"))
        side = lambda k: place.select(F.col("c").alias(f"col{k}"), F.col("v").alias(f"v{k}"), F.col("i").alias(f"i{k}"))
        got = counts.join(side(1), ["col1", "v1"]).join(side(2), ["col2", "v2"]).select("i1", "i2", "n").toArrow()
        i, j, n = (got.column(c).to_numpy() for c in ("i1", "i2", "n"))
        burt[i, j] = burt[j, i] = n
    mass = np.sqrt(np.diag(burt))
    values, vectors = np.linalg.eigh(burt / np.outer(mass, mass) / columns)
    keep = np.argsort(values)[::-1][1 : 1 + k]
    scores = vectors[:, keep] * np.sqrt(rows * columns) / mass[:, None] * np.sqrt(np.maximum(values[keep], 0))
    scores *= np.where(scores[np.abs(scores).argmax(0), range(scores.shape[1])] < 0, -1, 1)
    return singles.sparkSession.createDataFrame([(*c, scores[i].tolist()) for c, i in at.items()], "c string, v string, scores array<double>"), values[keep]


def _by_iteration(singles: DataFrame, counts: DataFrame, columns: int, k: int, rows: float, rounds: int | None = None) -> tuple[DataFrame, np.ndarray]:
    spark, size, rounds = singles.sparkSession, k + 1, ROUNDS if rounds is None else rounds
    name = lambda c, v: F.concat_ws("\x1f", c, v)
    mass = materialised(singles.select("c", "v", name("c", "v").alias("a"), F.sqrt(F.col("n").cast("double")).alias("m")))
    both = counts.select(F.inline(F.array(*(F.struct(name(*x).alias("a"), name(*y).alias("b"), "n") for x, y in ((("col1", "v1"), ("col2", "v2")), (("col2", "v2"), ("col1", "v1")))))))
    both = both.unionByName(singles.select(name("c", "v").alias("a"), name("c", "v").alias("b"), "n"))
    weight = F.col("n") / (F.col("m") * F.col("mb")) / columns
    table = materialised(both.join(mass.select("a", "m"), "a").join(mass.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").select("a", "b", weight.alias("w")))
    # the first vector is known: the roots of the masses
    x = mass.select("a", "c", "v", "m", *(F.col("m").alias("x0") if i == 0 else (F.xxhash64("a", F.lit(i)) / 2.0**63).alias(f"x{i}") for i in range(size)))

    def products(d: DataFrame, left: str, right: str) -> np.ndarray:
        got = d.agg(*(F.sum(F.col(f"{left}{i}") * F.col(f"{right}{j}")).alias(f"g{i}_{j}") for i in range(size) for j in range(size))).first()
        return np.array(got, float).reshape(size, size)

    def turned(d: DataFrame, by: np.ndarray, source: str, kept: Sequence[str] = ()) -> DataFrame:
        return d.select("a", "c", "v", "m", *kept, *(sum((F.col(f"{source}{i}") * float(by[i, j]) for i in range(size)), F.lit(0.0)).alias(f"x{j}") for j in range(size)))

    before = None
    for k_ in range(rounds + 1):
        x = materialised(turned(x, np.linalg.inv(np.linalg.cholesky(products(x, "x", "x"))).T, "x"))
        y = table.join(x.select(F.col("a").alias("b"), *(f"x{i}" for i in range(size))), "b").groupBy("a").agg(*(F.sum(F.col("w") * F.col(f"x{i}")).alias(f"y{i}") for i in range(size)))
        if k_:
            unused(x.sparkSession, xy)
        xy = written(x.join(y, "a"))  # a file's size is known; of checkpoints the guessed size's digits would double every round
        h = products(xy, "x", "y")
        now = np.linalg.eigvalsh((h + h.T) / 2)
        if k_ == rounds or (before is not None and np.abs(now - before).max() <= TOLERANCE * np.abs(now).max()):
            break
        before = now
        x = xy.select("a", "c", "v", "m", *(F.col(f"y{i}").alias(f"x{i}") for i in range(size)))
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    keep = np.argsort(values)[::-1][1:size]
    by = np.zeros((size, size))
    by[:, : len(keep)] = vectors[:, keep] * np.sqrt(rows * columns) * np.sqrt(np.maximum(values[keep], 0))
    out = turned(xy, by, "x").select("c", "v", *((F.col(f"x{i}") / F.col("m")).alias(f"s{i}") for i in range(len(keep))))
    tops = out.agg(*(F.max_by(f"s{i}", F.abs(f"s{i}")).alias(f"s{i}") for i in range(len(keep)))).first()
    return out.select("c", "v", F.array(*(F.col(f"s{i}") * (-1.0 if tops[i] < 0 else 1.0) for i in range(len(keep)))).alias("scores")), values[keep]


def encode(df: DataFrame, numbers: Sequence[str], texts: Sequence[str], refine: bool = False) -> tuple[DataFrame, np.ndarray | None]:
    """Standardised numbers beside encoded categories: frequencies, or 0.7 of them and 0.3 of (z + 1) / 2 of the first
    component of correspondence analysis, whose explained shares of inertia are then given too."""
    out, explained = df, None
    if refine and texts:
        scores, values, total = category_scores(df, texts)
        explained = values / total if total > 0 else values
        first = scores.select("c", "v", F.element_at("scores", 1).alias("s"))
        by_column = first.groupBy("c").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("dev"))
        z = materialised(first.join(by_column, "c").select("c", F.col("v").alias("_k"), ((F.coalesce((F.col("s") - F.col("mean")) / F.nullif(F.col("dev"), F.lit(0.0)), F.lit(0.0)) + 1) / 2).alias("_z")))
        for c in texts:
            out = out.withColumn("_k", F.coalesce(col(c), F.lit(MISSING))).join(small_or_not(z.filter(F.col("c") == c).drop("c")), "_k").withColumnRenamed("_z", f"_z_{c}").drop("_k")
    out = frequency_encoding(out, texts)
    if refine:
        out = out.withColumns({c: 0.7 * col(c) + 0.3 * col(f"_z_{c}") for c in texts}).drop(*(f"_z_{c}" for c in texts))
    return zscores(out, [*numbers]).select(ROW_ID, *named([*numbers, *texts])), explained


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature_i, feature_j, cov for all ordered pairs; sample covariance over rows where both are present."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*(F.covar_samp(col(a).cast("double"), col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(x).alias("feature_i"), F.lit(y).alias("feature_j"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return one.select(F.inline(F.array(*rows)))


def matrix(cov: DataFrame, columns: Sequence[str]) -> np.ndarray:
    got = {(r.feature_i, r.feature_j): r.cov for r in cov.collect()}
    return np.array([[np.nan if got[a, b] is None else got[a, b] for b in columns] for a in columns], float)


def summary(cov: DataFrame) -> DataFrame:
    return cov.agg(F.min("cov").alias("min"), F.max("cov").alias("max"), F.avg("cov").alias("mean"), F.stddev_pop("cov").alias("std"))


def distances(cov: np.ndarray) -> np.ndarray:
    """1 - scaled covariance, symmetric with a zero diagonal; all zero if any is missing or all are equal."""
    low, high = cov.min(), cov.max()
    d = 1 - (cov - low) / (high - low) if high > low else np.zeros_like(cov)
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    return d


def linkage(d: np.ndarray, method: str = "ward") -> np.ndarray:
    """Merges as rows (a, b, height, size), by the Lance-Williams update; clusters are numbered as they form."""
    n = len(d)
    d, size, names, out = d.astype(float).copy(), dict.fromkeys(range(n), 1), list(range(n)), []
    np.fill_diagonal(d, np.inf)
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b, h = names[i], names[j], d[i, j]
        out.append([min(a, b), max(a, b), h, size[a] + size[b]])
        for k in range(len(names)):
            if k in (i, j):
                continue
            x, y, na, nb, nk = d[i, k], d[j, k], size[a], size[b], size[names[k]]
            new = {"single": min(x, y), "complete": max(x, y), "average": (na * x + nb * y) / (na + nb)}.get(method)
            if new is None:
                new = np.sqrt(max(0.0, ((na + nk) * x * x + (nb + nk) * y * y - nk * h * h) / (na + nb + nk)))
            d[i, k] = d[k, i] = new
        d = np.delete(np.delete(d, j, 0), j, 1)
        names[i] = n + step
        size[n + step] = size[a] + size[b]
        del names[j]
    return np.array(out, float).reshape(-1, 4)


def leaves(merges: np.ndarray, n: int) -> list[int]:
    """Left to right order of the tree's leaves."""
    if n <= 1 or not len(merges):
        return list(range(n))
    order, todo = [], [n + len(merges) - 1]
    while todo:
        k = todo.pop()
        if k < n:
            order.append(k)
        else:
            todo += [int(merges[k - n][1]), int(merges[k - n][0])]
    return order


def analyse(df: DataFrame, columns: Sequence[str], drop_na: bool = False, refine: bool = False, method: str = "ward") -> dict:
    """Covariance table, matrix, linkage, the clustered order of the columns, rows, and the inertia's explained shares; skipped columns are named."""
    numbers, texts, skipped = classify(df, columns)
    rows = df.dropna(subset=[quoted(c) for c in columns]) if drop_na else df
    features = [*numbers, *texts]
    if not features:
        raise ValueError("no numeric or categorical column")
    encoded, explained = encode(rows, numbers, texts, refine)
    cov = covariance(encoded, features)
    m = matrix(cov, features)
    merges = linkage(distances(m), method) if len(features) > 1 else np.zeros((0, 4))
    return {"covariance": cov, "matrix": m, "features": features, "skipped": skipped, "linkage": merges, "order": [features[i] for i in leaves(merges, len(features))], "explained_inertia": explained, "rows": rows.count()}


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows, complete, and the missing values of each column."""
    return df.agg(F.count("*").alias("rows"), F.count_if(~sum((col(c).isNull().cast("int") for c in columns), F.lit(0)).cast("boolean")).alias("complete"), *(F.count_if(col(c).isNull()).alias(f"na_{c}") for c in columns))


