"""Tables written once in the shared folder, and positions in a global order computed from them.

Positions and running totals need the row counts of earlier partitions. The ordered
partitions are written by ``checkpoint()`` first: planned twice, counts and rows may be
partitioned differently.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tabweave-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


_LOCAL: list[str] = []
_SCRATCH: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; ``clear`` removes what was written there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def clear(spark: SparkSession) -> int:
    """Removes this process's scratch folders; results that read them are gone then. Returns how many there were.

    Checkpoints go by themselves once nothing refers to them, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    gone = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder, so that lost executors don't undo it and its plan ends there."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: compressed, a third of a checkpoint or less."""
    path = scratch(df.sparkSession, "written")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the scratch folders that these tables read; shuffles that nothing refers to go with the JVM's next collection, which is asked for."""
    for path in {f[: f.index("/", f.index("/written-") + 1)] for t in tables for f in t.inputFiles() if "/written-" in f}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._jvm.System.gc()


#: Largest table (rows) that is ever broadcast; larger ones take a shuffle join.
BROADCAST_ROWS = 200_000


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def running(df: DataFrame, value: Column, name: str, order: list[Column | str] | None = None, kind: str = "long") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before, in the given order or that of the rows.

    Only sums of partitions meet in one task; rows keep their partitions.
    """
    rows = df.orderBy(*order) if order else df
    rows = materialised(rows.withColumns({"_tw_at": F.monotonically_increasing_id(), "_tw_v": value.cast(kind)}))
    part = F.shiftright("_tw_at", 33)
    sums = rows.groupBy(part.alias("_tw_p")).agg(F.sum("_tw_v").alias("_tw_s"))
    before = sums.select("_tw_p", (F.sum("_tw_s").over(Window.orderBy("_tw_p")) - F.col("_tw_s")).alias("_tw_b"))  # a row per partition
    inside = F.sum("_tw_v").over(Window.partitionBy("_tw_p").orderBy("_tw_at")) - F.col("_tw_v")
    return rows.withColumn("_tw_p", part).join(F.broadcast(before), "_tw_p").withColumn(name, F.col("_tw_b") + inside).drop("_tw_at", "_tw_v", "_tw_p", "_tw_b")


def numbered(df: DataFrame, name: str, order: list[Column | str] | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the given order or that of the rows; without a shuffle in the latter case."""
    rows = df.orderBy(*order) if order else df
    rows = materialised(rows.withColumn("_tw_at", F.monotonically_increasing_id()))
    part = F.shiftright("_tw_at", 33)
    counts = rows.groupBy(part.alias("_tw_p")).agg(F.count("*").alias("_tw_n"))
    before = counts.select("_tw_p", (F.sum("_tw_n").over(Window.orderBy("_tw_p")) - F.col("_tw_n")).alias("_tw_b"))  # a row per partition
    place = F.col("_tw_at").bitwiseAND((1 << 33) - 1) + F.col("_tw_b")
    return rows.withColumn("_tw_p", part).join(F.broadcast(before), "_tw_p").withColumn(name, place).drop("_tw_at", "_tw_p", "_tw_b")


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> list[float]:
    """Exact interpolated quantiles of a numeric column, from the running counts of its distinct values; none for no values."""
    counts = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    placed = materialised(running(counts, F.col("n"), "before", ["v"]))
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return []
    at = [s * (total - 1) for s in shares]
    wanted = sorted({int(x) for x in at} | {min(total - 1, int(x) + 1) for x in at})
    ranks = df.sparkSession.createDataFrame([(x,) for x in wanted], "rank long")
    hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    found = {r["rank"]: r.v for r in placed.join(F.broadcast(ranks), hit).select("rank", "v").collect()}  # a few ranks
    out = []
    for x in at:
        low, high = found[int(x)], found[min(total - 1, int(x) + 1)]
        out.append(low + (high - low) * (x - int(x)))
    return out
