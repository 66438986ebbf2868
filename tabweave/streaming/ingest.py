"""Files that keep arriving: cleaned as a stream, with counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabweave.functions.names import col
from tabweave.operators.clean import strip_texts


def cleaned_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """New CSV files of a folder, trimmed, blanks as nulls."""
    reader = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger)
    return strip_texts(reader.csv(folder))


def missing_per_window(stream: DataFrame, time: str, columns: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and missing values per window of event time; later rows than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("rows"), *(F.count_if(col(c).isNull()).alias(f"na_{c}") for c in columns))


def write_stream(stream: DataFrame, folder: str, checkpoint: str, once: bool = True):
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
