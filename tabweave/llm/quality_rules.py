"""Quality rules: a threshold table compiled into one projection, without user functions.

Null and empty texts have zero words and fail the base rule. Repeated rows are
judged one by one. Word windows are compared by 64-bit hashes within one text.
Texts are read whole, of any length: windows are numbered within the row, so that a very long one is one task's work. Columns of the
input named as the added measures are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import GAP

#: Frequent function words of the four languages handled.
STOP_WORDS = {
    "en": "the of and to in that is was for on with as it at by be this are from or an not have".split(),
    "fr": "le la les de des du et un une en que qui dans pour est par sur au plus avec ne se".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "el la los las de que y en un una por con no se del para es al lo como más".split(),
}
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A ratio must lie within [least, most]; None leaves a side open."""

    ratio: str
    least: float | None = None
    most: float | None = None

    def sql(self) -> str:
        sides = ([f"{self.ratio} >= {self.least!r}"] if self.least is not None else []) + ([f"{self.ratio} <= {self.most!r}"] if self.most is not None else [])
        return f"({' AND '.join(sides)})"


#: Ratios are per word unless named otherwise. Edit or extend to taste.
THRESHOLDS = (
    Rule("word_chars / n_words", 1.5, 20.0),
    Rule("n_symbols / n_words", None, 0.2),
    Rule("n_bangs / n_words", None, 0.5),
    Rule("n_stop / n_words", 0.01, None),
    Rule("n_dup_lines / n_lines", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _covered(places: Column) -> Column:
    """Words covered by windows of three that start at the sorted ``places``."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop, n_bangs."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    t, words, hashes, pairs, again = (F.col(f"_tw_{x}") for x in ("text", "words", "hashes", "pairs", "again"))
    n = F.size(words)
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = df.withColumn("_tw_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_tw_bare", F.regexp_replace("_tw_text", rf"^{GAP}|{GAP}\z", ""))
    out = out.withColumn("_tw_words", F.when(F.col("_tw_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_tw_bare", GAP)))
    out = out.withColumn("_tw_hashes", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_tw_lines", lines)
    # Only texts with a repeated window pay for sorting their windows.
    out = out.withColumn("_tw_pairs", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    out = out.withColumn("_tw_again", F.sort_array(F.transform(F.filter(pairs, lambda x, i: x.h.eqNullSafe(F.get(pairs, i - 1).h) | x.h.eqNullSafe(F.get(pairs, i + 1).h)), lambda x: x.p)))
    out = out.select(
        *df.columns,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_tw_lines").cast("long").alias("n_lines"),
        (F.size("_tw_lines") - F.size(F.array_distinct("_tw_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(again), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop"),
        F.length(F.regexp_replace(t, "[^!]+", "")).cast("long").alias("n_bangs"),
        # keeps the optimizer from copying all of the above into filters on the verdict
        F.monotonically_increasing_id().alias("_tw_row"),
    )
    return out


def verdict(rules=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression; null ratios (no words or lines) fail."""
    sql = " AND ".join(r.sql().replace(" / n_words", " / nullif(n_words, 0)").replace(" / n_lines", " / nullif(n_lines, 0)") for r in rules)
    return F.coalesce(F.expr(sql), F.lit(False))


def judge(df: DataFrame, text: str = "text", rules=THRESHOLDS, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Adds the measures, base_failed and kept to ``df``; its own columns of those names are replaced."""
    names = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_bangs", "base_failed", "kept"}
    out = measures(df.drop(*(names - {text})), text)
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules) & (F.col("_tw_row") >= 0)).drop("_tw_row")
