"""Column expressions for trimming, missing values and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DatetimeType, DecimalType, DoubleType, FloatType, FractionalType, StringType

from tabweave.functions.names import col

#: Strings that a CSV reader takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip(c: Column) -> Column:
    """Removes white space at both ends, as Unicode defines it."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def starts_with_space(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"(?U)^\s+.+"))


def ends_with_space(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"(?U)^.+\s+\z"))


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def number_text(c: Column) -> Column:
    """A double in its shortest digits: positional from 1e-4 up to 1e16, as ``1e-05`` or ``1.5e+16`` beyond; ``nan``, ``inf``, ``-inf``."""
    text = c.cast("double").cast("string")
    sign, bare = F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.regexp_replace(text, "^-", "")
    whole, part, e = (F.regexp_extract(bare, r"^(\d+)\.(\d+)E(-?\d+)$", i) for i in (1, 2, 3))
    power, part = F.coalesce(e.try_cast("int"), F.lit(0)), F.when(part == "0", "").otherwise(part)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), whole, part)
    padded = F.rpad(part, F.greatest(power, F.length(part)), "0")
    large = F.concat(whole, F.substring(padded, F.lit(1), power), F.lit("."), F.when(F.length(part) > power, F.substring(part, power + 1, F.length(part))).otherwise("0"))
    short = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    shown = F.when((power < -4) | (power >= 16), short).when(power < 0, small).otherwise(large)
    return F.when(bare == "NaN", "nan").when(bare == "Infinity", F.concat(sign, F.lit("inf"))).when(e != "", F.concat(sign, shown)).otherwise(text)


def as_text(c: Column, kind: DataType, missing: str | None = None) -> Column:
    """How the value prints in a table: whole doubles as ``2.0``, tiny ones as ``1e-05``, booleans as ``True``."""
    if isinstance(kind, BooleanType):
        out = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, FractionalType):
        out = c.cast("string") if isinstance(kind, DecimalType) else number_text(c.cast("string").cast("double"))
    else:
        out = c if isinstance(kind, StringType) else c.cast("string")
    return out if missing is None else F.coalesce(out, F.lit(missing))


def shorten(c: Column, most: int = 30) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def wrap(label: str, width: int = 16) -> str:
    """Breaks a label at blanks and underscores into lines of at most ``width`` characters where it can."""
    lines, line = [], ""
    for word in label.replace("_", "_ ").split():
        if line and len(line) + len(word) + (not line.endswith("_")) > width:
            lines.append(line)
            line = word
        else:
            line += word if not line or line.endswith("_") else " " + word
    return "\n".join([*lines, line])


def percent(x: float) -> str:
    return f"{x:.2%}"


def shown(c: Column, digits: int = 4) -> Column:
    """Fixed digits, without separators. What lies half-way between two numbers goes to the even digit, as the double's exact value says."""
    c = c.cast("double")
    size, scale = F.abs(c), 2.0 * 10**digits
    half = F.rint(size * scale)  # odd where the value is nearest to a half-way point; its exact distance from that decides
    split = size * (2.0**27 + 1)
    high = split - (split - size)
    error = (high * scale - half) + (size - high) * scale
    down = F.floor(half / 2)
    units = F.when(error == 0, down + down % 2).otherwise(down + (error > 0).cast("long"))
    out = F.when(half % 2 == 1, F.signum(c) * units / 10**digits).otherwise(c)
    return F.when(F.isnan(c) | (size == float("inf")), number_text(c)).when(c.isNotNull(), F.format_string(f"%.{digits}f", out))


def shown_percent(c: Column) -> Column:
    """A share as a percentage with two digits."""
    return F.concat(shown(c.cast("double") * 100, 2), F.lit("%"))


def shown_thousands(c: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(c.cast("long"), 0)


def short_hash(*columns: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the MD5 of the values as text, with a separator between them; missing values count as empty."""
    return F.substring(F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).cast("binary")), 1, digits)


def json_safe(c: Column, kind: DataType) -> Column:
    """The value as JSON can hold it: numbers that aren't finite become null, times become text."""
    if isinstance(kind, DoubleType | FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return c.cast("string") if isinstance(kind, DatetimeType) else c


def json_row(df: DataFrame) -> Column:
    """A row as a JSON object, missing values as null."""
    return F.to_json(F.struct(*(json_safe(col(f.name), f.dataType).alias(f.name) for f in df.schema)), {"ignoreNullFields": "false"})


def json_object(c: Column) -> Column:
    """The outermost {...} of a reply, else null."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def close_braces(c: Column) -> Column:
    """Appends missing closing braces, after dropping a trailing comma."""
    lack = F.greatest(F.lit(0), (F.length(c) - F.length(F.replace(c, F.lit("{"), F.lit("")))) - (F.length(c) - F.length(F.replace(c, F.lit("}"), F.lit("")))))
    return F.when(lack > 0, F.concat(F.regexp_replace(c, r"\s*,?\s*$", ""), F.repeat(F.lit("}"), lack))).otherwise(c)


def json_mapping(c: Column) -> Column:
    """The reply's mapping, with braces repaired; null if it can't be parsed."""
    return F.from_json(close_braces(F.coalesce(json_object(c), F.regexp_extract(c, r"(?s)\{.*", 0))), "map<string,string>")


def significant(x: float, digits: int = 3) -> float:
    """Rounded to so many significant digits of its fractional part, as interval labels are."""
    if x == 0 or not math.isfinite(x):
        return x
    whole, part = math.floor(abs(x)), abs(x) % 1
    places = digits if whole else digits - 1 - math.floor(math.log10(part))
    return round(x, places)
