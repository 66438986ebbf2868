"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by (source, language, topic) cell. Raking scales the
cells' weights to the target marginals of each dimension in turn. A document is
kept with its cell's calibrated probability min(1, lambda * weight / tokens),
where lambda makes the expected kept tokens a given share of all; the draw is a
hash of the key, so that a rerun keeps the same documents.

DataFrame functions only. Null values of a dimension are the value ``''``.
Documents without words have weight 0 and are drawn with probability
min(1, lambda). Rows that repeat share their draw, as do rows with a null key. Cells of equal weight a token are in the order of
their dimensions. Texts are counted whole, of any length. An empty table gives no rows. A fixed
number of sweeps is made; targets that the cells allow are then met to about one in a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import BROADCAST_ROWS, WORD, durable, small_or_not
from tabweave.storage import running, unused, written

DIMENSIONS = ("source", "lang", "topic")
#: Targets are the observed token shares to this power, normalised, where none are given.
TEMPERATURE = 0.7
SWEEPS, SHARE = 10, 0.9


def topic(text: Column) -> Column:
    """A coarse topic from the text's form."""
    return F.when(F.contains(text, F.lit("|")), "table").when(F.contains(text, F.lit("@")), "contact").when(F.regexp_like(text, F.lit("[0-9]{4}")), "figures").otherwise("prose")


def draw(key: Column) -> Column:
    """A uniform number in [0, 1) from the MD5 of the key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, whose marginals are the targets as closely as the cells allow.

    ``targets`` gives a dimension's wanted shares by value; values that it leaves out get none.
    """
    total = F.sum("tokens").over(Window.partitionBy())
    out = cells.withColumn("_tw_total", total)
    for d in DIMENSIONS:
        if targets and d in targets:
            wanted = F.coalesce(*(F.when(F.col(d) == v, F.lit(float(x))) for v, x in targets[d].items()), F.lit(0.0))
        else:
            wanted = F.pow(F.sum("tokens").over(Window.partitionBy(d)).cast("double"), temperature)
        out = out.withColumn(f"_tw_raw_{d}", wanted)
        # each value of the dimension counts once: its share of its own tokens sums to one
        one = F.col(f"_tw_raw_{d}") * F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(d)))
        out = out.withColumn(f"_tw_one_{d}", F.coalesce(one, F.lit(0.0))).withColumn(f"_tw_t_{d}", F.try_divide(F.col("_tw_total") * F.col(f"_tw_raw_{d}"), F.sum(f"_tw_one_{d}").over(Window.partitionBy())))
    out = out.withColumn("weight", F.col("tokens").cast("double"))
    for k in range(sweeps):
        if k and k % 10 == 0:
            out = durable(out)  # deeper plans overflow the stack
        for d in DIMENSIONS:
            out = out.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"_tw_t_{d}"), F.sum("weight").over(Window.partitionBy(d))), F.lit(0.0)))
    return out.select(*DIMENSIONS, "tokens", "weight")


def rake_by_joins(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, sweeps: int = SWEEPS) -> DataFrame:
    """``rake`` for tables of any size: marginals are grouped sums joined back, and every step is written once."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("_tw_own"))
        raw = F.pow(F.col("_tw_own").cast("double"), temperature)
        if targets and d in targets:
            raw = F.coalesce(*(F.when(F.col(d) == v, F.lit(float(x))) for v, x in targets[d].items()), F.lit(0.0))
        sums = durable(sums.withColumn("_tw_raw", raw))
        known = sums.agg(F.sum(F.when(F.col("_tw_own") > 0, F.col("_tw_raw")))).first()[0]
        wanted[d] = sums.select(d, F.try_divide(total * F.col("_tw_raw"), F.lit(known).cast("double")).alias("_tw_goal"))
    out = first = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for d in DIMENSIONS:
            factor = out.groupBy(d).agg(F.sum("weight").alias("_tw_sum")).join(wanted[d], d).select(d, F.try_divide("_tw_goal", "_tw_sum").alias("_tw_factor"))
            # a file's size is known; of checkpoints the guessed size's digits would double every step
            before, out = out, written(out.join(factor, d).withColumn("weight", F.coalesce(F.col("weight") * F.col("_tw_factor"), F.lit(0.0))).drop("_tw_factor"))
            if before is not first:
                unused(cells.sparkSession, before)
    return out.select(*DIMENSIONS, "tokens", "weight")


def calibrate_by_ranges(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """``calibrate`` for tables of any size: sums before each cell come from ranges of the sorted cells."""
    out = cells.withColumn("_tw_r", F.coalesce(F.try_divide(F.col("weight"), F.col("tokens")), F.lit(1.0)))
    order = [F.desc("_tw_r"), *DIMENSIONS]
    out = running(running(out, F.col("tokens"), "_tw_full", order), F.col("weight"), "_tw_used", order, "double")
    all_tokens, all_weight = (x or 0 for x in out.agg(F.sum("tokens"), F.sum("weight")).first())
    multiplier = F.try_divide(share * all_tokens - F.col("_tw_full"), all_weight - F.col("_tw_used"))
    fits = (multiplier * F.col("_tw_r") <= 1) & (multiplier >= 0)
    chosen = out.filter(fits).agg(F.max_by(multiplier, F.struct("_tw_r", multiplier))).first()[0]
    probability = F.coalesce(F.least(F.lit(1.0), F.lit(chosen).cast("double") * F.col("_tw_r")), F.lit(1.0))
    return out.withColumn("probability", probability).select(*DIMENSIONS, "tokens", "weight", "probability")


def calibrate(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """Adds ``probability``: lambda is the least multiplier at which the cells' expected tokens reach ``share`` of all."""
    r = F.coalesce(F.try_divide(F.col("weight"), F.col("tokens")), F.lit(1.0))
    out = cells.withColumn("_tw_r", r)
    before = Window.orderBy(F.desc("_tw_r"), *DIMENSIONS).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    out = out.withColumn("_tw_full", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("_tw_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    budget = share * F.sum("tokens").over(everything)
    out = out.withColumn("_tw_lambda", F.try_divide(budget - F.col("_tw_full"), F.sum("weight").over(everything) - F.col("_tw_used")))
    # the first cell at which the multiplier leaves it uncapped; the sums before it are capped cells
    fits = F.when((F.col("_tw_lambda") * F.col("_tw_r") <= 1) & (F.col("_tw_lambda") >= 0), F.struct("_tw_r", "_tw_lambda"))
    chosen = F.max_by("_tw_lambda", fits).over(everything)
    return out.withColumn("probability", F.coalesce(F.least(F.lit(1.0), chosen * F.col("_tw_r")), F.lit(1.0))).select(*DIMENSIONS, "tokens", "weight", "probability")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, key: str = "doc_id", text: str = "text", temperature: float = TEMPERATURE, sweeps: int = SWEEPS, topics: Column | None = None) -> DataFrame:
    """``docs`` with topic, n_tokens, weight (per token, 1 is the average), probability and kept.

    ``topics`` gives each document's topic, as a column or a classifier has it; without it the text's form stands for one (see ``topic``).
    The table of cells is broadcast and raked in one task where it has at most
    ``BROADCAST_ROWS`` rows; else marginals are joined and cells sorted in ranges. Columns of the input
    named as the added ones are replaced, but for key and text.
    """
    added = ("topic", "n_tokens", "weight", "probability", "kept")
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs if topics is None else docs.withColumn("_tw_topic", topics)
    topics = None if topics is None else F.col("_tw_topic")
    keyed = docs.drop(*(c for c in added if c in docs.columns and c not in (key, text)))
    keyed = keyed.withColumns({"topic": topic(body) if topics is None else F.coalesce(topics.cast("string"), F.lit("")), "n_tokens": F.regexp_count(body, F.lit(WORD)).cast("long"), "_tw_source": F.coalesce(F.col("source"), F.lit("")), "_tw_lang": F.coalesce(F.col("lang"), F.lit(""))})
    cells = durable(keyed.groupBy(F.col("_tw_source").alias("source"), F.col("_tw_lang").alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens")))
    if cells.count() <= BROADCAST_ROWS:  # one partition needs no further shuffle for any of the windows
        ready = durable(calibrate(durable(rake(cells.repartition(1), targets, temperature, sweeps)).repartition(1), share))
    else:
        ready = durable(calibrate_by_ranges(rake_by_joins(cells, targets, temperature, sweeps), share))
    table = ready.select(F.col("source").alias("_tw_source"), F.col("lang").alias("_tw_lang"), "topic", F.coalesce(F.try_divide(F.col("weight"), F.col("tokens")), F.lit(0.0)).alias("weight"), "probability")
    out = keyed.join(small_or_not(table), ["_tw_source", "_tw_lang", "topic"])
    rest = [c for c in keyed.columns if c not in ("_tw_source", "_tw_lang", "_tw_topic", "topic", "n_tokens")]
    return out.withColumn("kept", draw(F.col(key)) < F.col("probability")).select(*rest, *added)


def sql(documents: str, share: float = SHARE, temperature: float = TEMPERATURE, sweeps: int = SWEEPS) -> str:
    """The same for DuckDB: rows of ``documents`` with topic, n_tokens, weight, probability, kept."""
    steps, at = [], "w0"
    shares = ", ".join(f"pow(CAST(sum(tokens) OVER (PARTITION BY {d}) AS DOUBLE), {temperature}) AS raw_{d}, sum(tokens) OVER (PARTITION BY {d}) AS all_{d}" for d in DIMENSIONS)
    goals = ", ".join(f"(sum(tokens) OVER ()) * raw_{d} / nullif(sum(coalesce(raw_{d} * tokens / nullif(all_{d}, 0), 0)) OVER (), 0) AS t_{d}" for d in DIMENSIONS)
    for i in range(sweeps * len(DIMENSIONS)):
        d = DIMENSIONS[i % len(DIMENSIONS)]
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * (t_{d} / nullif(sum(weight) OVER (PARTITION BY {d}), 0)), 0) AS weight) FROM {at})")
        at = f"w{i + 1}"
    return f"""
        keyed AS MATERIALIZED (SELECT *, CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
                   WHEN regexp_matches(coalesce(text, ''), '[0-9]{{4}}') THEN 'figures' ELSE 'prose' END AS topic,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, coalesce(source, '') AS k_source, coalesce(lang, '') AS k_lang FROM {documents}),
        cells AS MATERIALIZED (SELECT k_source AS source, k_lang AS lang, topic, sum(n_tokens) AS tokens FROM keyed GROUP BY ALL),
        shares AS (SELECT *, {shares} FROM cells), w0 AS MATERIALIZED (SELECT *, {goals}, CAST(tokens AS DOUBLE) AS weight FROM shares),
        {", ".join(steps)},
        ranked AS MATERIALIZED (SELECT *, coalesce(weight / nullif(tokens, 0), 1.0) AS r FROM {at}),
        sums AS (SELECT *, coalesce(sum(tokens) OVER before, 0) AS full_before, coalesce(sum(weight) OVER before, 0) AS used, sum(tokens) OVER () AS all_tokens, sum(weight) OVER () AS all_weight FROM ranked
                 WINDOW before AS (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        lambdas AS (SELECT *, ({share} * all_tokens - full_before) / nullif(all_weight - used, 0) AS mult FROM sums),
        chosen AS (SELECT (SELECT mult FROM lambdas WHERE mult * r <= 1 AND mult >= 0 ORDER BY r DESC, mult DESC LIMIT 1) AS mult),
        mixed AS (SELECT keyed.* EXCLUDE (k_source, k_lang), coalesce(c.weight / nullif(c.tokens, 0), 0) AS weight, coalesce(least(1.0, chosen.mult * c.r), 1.0) AS probability,
                         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < coalesce(least(1.0, chosen.mult * c.r), 1.0) AS kept
                  FROM keyed JOIN ranked c ON k_source = c.source AND k_lang = c.lang AND keyed.topic = c.topic, chosen)"""
