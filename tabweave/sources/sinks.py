"""Writers: CSV in several encodings, text and JSON trees, names with a time stamp."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.names import col
from tabweave.operators.pairs import ROW_ID

#: Encodings offered for export.
ENCODINGS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "cp1252": "windows-1252"}


def stamped(prefix: str, suffix: str = ".csv", now: datetime | None = None) -> str:
    return f"{prefix}_{(now or datetime.now()):%Y%m%d_%H%M%S}{suffix}"


def write_csv(df: DataFrame, folder: str, encoding: str = "utf-8", with_id: bool = False, sep: str = ",", single: bool = False) -> None:
    """CSV with a header; raises if a text or a column's name can't be written in the encoding. ``single`` gives one part file."""
    name, conf = ENCODINGS[encoding.lower()], df.sparkSession.conf
    out = df if with_id else df.drop(ROW_ID)
    if name != "UTF-8":
        "".join(out.columns).encode(encoding)
        other = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in bytes(range(256)).decode(encoding, "ignore")) + "]"
        bad = [F.coalesce(F.regexp_like(col(c), F.lit(other)), F.lit(False)) for c, k in out.dtypes if k == "string"]
        if bad and not out.filter(reduce(Column.__or__, bad)).isEmpty():
            raise UnicodeError(f"some texts can't be encoded as {encoding}")
    out = out.coalesce(1) if single else out
    writer = out.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("encoding", name)
    before = conf.get("spark.sql.legacy.javaCharsets", "false")
    conf.set("spark.sql.legacy.javaCharsets", "true" if name == "windows-1252" else before)
    try:
        writer.csv(folder)
    finally:
        conf.set("spark.sql.legacy.javaCharsets", before)


def write_semicolon(df: DataFrame, folder: str) -> None:
    write_csv(df, folder, sep=";")
