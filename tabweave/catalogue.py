"""All queries of the engine proper and their SQL, by name.

Every query runs over its whole tables. SQL is given where the operation is
expressible in it; the rest is held against small examples in the tests.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.text import json_mapping
from tabweave.operators import assoc, batches, clean, covariance, graphs, impute, pairs, relations, repair, valuetree, vendors
from tabweave.functions.text import json_row, short_hash, shorten, shown, shown_percent, shown_thousands
from tabweave.plans.fixtures import CNR, DIRTY, GROUPS, LINES, ORD, frame, plain
from tabweave.session import Session
from tabweave.sources import readers, sinks
from tabweave.storage import numbered
from tabweave.storage import scratch as _scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TEXTS = ("status", "priority", "segment", "nation", "region")


def query(name: str, fixture: str, sql: str | None = None):
    """Registers a function of the fixture's DataFrame, and its SQL over the fixture as ``f``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(frame(spark, sf_dir, fixture))
        if sql is not None:
            head, sep, rest = sql.strip().partition("WITH ")
            recursive = "RECURSIVE " * rest.startswith("RECURSIVE ")
            more = f", {rest.removeprefix(recursive)}" if sep and not head else f" {sql.strip()}"
            ORACLES[name] = f"WITH {recursive}f AS ({plain(fixture)}){more}"
        return f

    return add


# --- relationships -----------------------------------------------------------


def _score_sql(parent: str, child: str, drop: bool = True) -> str:
    where = f"WHERE {parent} IS NOT NULL AND {child} IS NOT NULL" if drop else ""
    return f"""SELECT '{parent}' AS parent, '{child}' AS child, CAST(coalesce(sum(CASE WHEN c IS NOT NULL AND k = 1 THEN n END), 0) AS BIGINT) AS valid, CAST(coalesce(sum(n), 0) AS BIGINT) AS total,
        (SELECT count(DISTINCT {parent}) FROM f) AS distinct_parent, (SELECT count(DISTINCT {child}) FROM f) AS distinct_child
        FROM (SELECT {child} AS c, count(DISTINCT {parent}) AS k, count(*) AS n FROM {{src}} {where} GROUP BY {child})""".replace("{src}", "f")


_SCORED = "SELECT parent, child, valid, total, round(coalesce(100.0 * valid / nullif(total, 0), 0), 6) AS percentage, round(CASE WHEN valid > 0 THEN 1 - (100.0 * valid / total) / 100 ELSE 1.0 END, 6) AS violation_ratio, distinct_parent, distinct_child FROM s"


def _scored(df: DataFrame) -> DataFrame:
    return df.select("parent", "child", "valid", "total", F.round("percentage", 6).alias("percentage"), F.round("violation_ratio", 6).alias("violation_ratio"), "distinct_parent", "distinct_child")


@query("one_to_many_score", CNR, f"WITH s AS ({_score_sql('parent', 'child', False)}) {_SCORED}")
def one_to_many_score(df: DataFrame) -> DataFrame:
    return _scored(pairs.one_to_many(pairs.directed(pairs.pair_counts(df, [("parent", "child")])), drop_na=False).filter("parent = 'parent'"))


@query("one_to_many_row_mask", CNR, "SELECT initial_id, coalesce(k = 1, false) AS valid FROM f LEFT JOIN (SELECT child, count(DISTINCT parent) AS k FROM f GROUP BY child) USING (child)")
def one_to_many_row_mask(df: DataFrame) -> DataFrame:
    return pairs.row_mask(df, "parent", "child").select("initial_id", "valid")


@query("one_to_many_all_pairs", ORD, f"WITH s AS ({' UNION ALL '.join(_score_sql(a, b) for a, b in permutations(TEXTS, 2))}) {_SCORED}")
def one_to_many_all_pairs(df: DataFrame) -> DataFrame:
    return _scored(pairs.analyse_one_to_many(df, 0, True, TEXTS))


_GROUPS = ("leaf", "branch", "other")
_SOME = f"s AS ({' UNION ALL '.join(_score_sql(a, b) for a, b in permutations(_GROUPS, 2))})"


@query("one_to_many_all_pairs_95", GROUPS, f"WITH {_SOME} {_SCORED} WHERE valid * 100.0 / nullif(total, 0) >= 95")
def one_to_many_95(df: DataFrame) -> DataFrame:
    return _scored(pairs.analyse_one_to_many(df, 95, True, _GROUPS))


_PLACE = f"list_position({list(_GROUPS)}, parent), list_position({list(_GROUPS)}, child)"


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    return numbered(df, "place").select("place", *columns)


@query("one_to_many_ranked", GROUPS, f"WITH {_SOME} SELECT row_number() OVER (ORDER BY coalesce(100.0 * valid / nullif(total, 0), 0) DESC, {_PLACE}) - 1 AS place, parent, child FROM s")
def one_to_many_ranked(df: DataFrame) -> DataFrame:
    return _placed(pairs.analyse_one_to_many(df, 0, True, _GROUPS), "parent", "child")


@query("errors_ranked", GROUPS, f"WITH {_SOME} SELECT row_number() OVER (ORDER BY CASE WHEN valid > 0 THEN 1 - (100.0 * valid / total) / 100 ELSE 1.0 END DESC, {_PLACE}) - 1 AS place, parent, child FROM s WHERE valid < total")
def errors_ranked(df: DataFrame) -> DataFrame:
    return _placed(pairs.analyse_errors(df, True, _GROUPS), "parent", "child")


#: A wide table of lines: keys that fix others, exact partners, and many columns without relations.
_WIDE = """SELECT l_orderkey * 10 + l_linenumber AS initial_id, l_orderkey AS ord, o_custkey AS cust, n_name AS nation, r_name AS region, 'n' || CAST(n_nationkey AS STRING) AS nation_key, l_partkey AS part, l_suppkey AS supp,
    l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_shipdate END AS shipped, o_orderpriority AS priority
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
_WIDE_COLUMNS = ("ord", "cust", "nation", "region", "nation_key", "part", "supp", "quantity", "discount", "tax", "flag", "shipped", "priority")


@query("one_to_many_wide", _WIDE, f"WITH s AS ({' UNION ALL '.join(_score_sql(a, b) for a, b in permutations(_WIDE_COLUMNS, 2))}) {_SCORED} WHERE valid * 100.0 / nullif(total, 0) >= 95")
def one_to_many_wide(df: DataFrame) -> DataFrame:
    return _scored(pairs.analyse_one_to_many(df, 95, True, _WIDE_COLUMNS))


def _one_sql(a: str, b: str, drop: bool) -> str:
    where = f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" if drop else ""
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, CAST(CASE WHEN bool_and(({a} IS NULL OR ka = 1) AND ({b} IS NULL OR kb = 1)) THEN count(*) ELSE count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL AND ka = 1 AND kb = 1) END AS BIGINT) AS valid, count(*) AS total
        FROM (SELECT {a}, {b} FROM f {where}) LEFT JOIN (SELECT {a} AS x, count(DISTINCT {b}) AS ka FROM f {where} GROUP BY {a}) ON {a} = x LEFT JOIN (SELECT {b} AS y, count(DISTINCT {a}) AS kb FROM f {where} GROUP BY {b}) ON {b} = y"""


def _one(drop: bool):
    def run(df: DataFrame) -> DataFrame:
        return pairs.analyse_one_to_one(df, 0, drop, (*TEXTS, "price")).select("col1", "col2", "valid", "total", F.round("percentage", 6).alias("percentage"))

    sql = " UNION ALL ".join(_one_sql(a, b, drop) for a, b in combinations((*TEXTS, "price"), 2))
    query(f"one_to_one_all_pairs{'' if drop else '_keep_na'}", ORD, f"WITH s AS ({sql}) SELECT col1, col2, valid, total, round(100.0 * valid / total, 6) AS percentage FROM s")(run)


_one(True)
_one(False)


@query("one_to_one_wide", _WIDE, f"WITH s AS ({' UNION ALL '.join(_one_sql(a, b, True) for a, b in combinations(_WIDE_COLUMNS, 2))}) SELECT col1, col2, valid, total, round(100.0 * valid / total, 6) AS percentage FROM s WHERE 100.0 * valid / total >= 95")
def one_to_one_wide(df: DataFrame) -> DataFrame:
    return pairs.analyse_one_to_one(df, 95, True, _WIDE_COLUMNS).select("col1", "col2", "valid", "total", F.round("percentage", 6).alias("percentage"))


@query("pair_samples_grouped", CNR, """WITH m AS (SELECT child FROM f GROUP BY child HAVING count(DISTINCT parent) = 1), s AS (SELECT * FROM f WHERE child NOT IN (SELECT child FROM m) ORDER BY initial_id LIMIT 1000)
    SELECT parent, child, count(*) AS occurrences, min(initial_id) AS first FROM s WHERE parent IS NOT NULL GROUP BY ALL""")  # fmt: skip
def pair_samples_grouped(df: DataFrame) -> DataFrame:
    return pairs.samples(df, "parent", "child", valid=False)


# --- repair ------------------------------------------------------------------

_PLAN = """c AS (SELECT child, parent, count(*) AS n, min(initial_id) AS first FROM f WHERE child IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY n DESC, first) AS r FROM c WHERE parent IS NOT NULL),
    t AS (SELECT child, max(parent) FILTER (r = 1) AS correct_value, count(*) AS parents, CAST(sum(n) AS BIGINT) AS present, max(n) FILTER (r = 1) AS top, coalesce(max(n) FILTER (r = 2), 0) AS second FROM r GROUP BY child),
    a AS (SELECT child, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY child),
    p AS (SELECT child AS cv, correct_value, parents, present, top, second, total - top AS num_changes,
                 present >= 5 AND 100.0 * top / present >= CASE WHEN present >= 100 THEN 60 WHEN present >= 50 THEN 65 WHEN present >= 20 THEN 70 WHEN present >= 10 THEN 75 WHEN present >= 5 THEN 80 ELSE 85 END
                 AND (second = 0 OR top >= 3.0 * second) AS confident FROM t JOIN a USING (child) WHERE parents > 1)"""


def _plan(df: DataFrame) -> DataFrame:
    return repair.plan_for_pair(df, "parent", "child", drop_na=False)


@query("correction_plan", CNR, f"WITH {_PLAN} SELECT * FROM p")
def correction_plan(df: DataFrame) -> DataFrame:
    return _plan(df).select("cv", "correct_value", "parents", "present", "top", "second", "num_changes", "confident")


@query("correction_preview", CNR, f"WITH {_PLAN} SELECT p.cv, c.parent AS current_value, c.n AS occurrences, correct_value, confident, c.parent <> correct_value AS changes FROM p JOIN c ON p.cv = c.child WHERE c.parent IS NOT NULL")
def correction_preview(df: DataFrame) -> DataFrame:
    edges = pairs.directed(pairs.pair_counts(df, [("parent", "child")])).filter("parent = 'parent'")
    return repair.preview(edges, repair.plans(edges, drop_na=False)).drop("parent", "child")


@query("corrections_confidence_totals", CNR, f"""WITH {_PLAN} SELECT count(*) AS corrections, CAST(sum(num_changes) AS BIGINT) AS changes, count(*) FILTER (confident) AS confident_corrections, CAST(coalesce(sum(num_changes) FILTER (confident), 0) AS BIGINT) AS confident_changes,
    count(*) FILTER (NOT confident) AS unsure_corrections, CAST(coalesce(sum(num_changes) FILTER (NOT confident), 0) AS BIGINT) AS unsure_changes FROM p""")  # fmt: skip
def corrections_confidence_totals(df: DataFrame) -> DataFrame:
    return repair.totals(_plan(df)).drop("parent", "child")


def _apply(confident: bool):
    def run(df: DataFrame) -> DataFrame:
        return repair.apply(df, repair.cells(df, _plan(df), "parent", "child", confident_only=confident, drop_na=False)).select("initial_id", "child", "parent")

    only = "AND confident" if confident else ""
    query(f"apply_corrections_{'confident' if confident else 'all'}", CNR, f"WITH {_PLAN} SELECT initial_id, child, CASE WHEN cv IS NOT NULL {only} THEN correct_value ELSE parent END AS parent FROM f LEFT JOIN p ON child = cv")(run)


_apply(True)
_apply(False)


_ALL_PAIRS = ("leaf", "branch", "other")


def _repair_sql(columns: tuple[str, ...], threshold: float, confident: bool) -> str:
    """The plans of all pairs with errors on one state of the table, applied in order."""
    scores, rows, plans = [], [], []
    for k, (a, b) in enumerate(permutations(columns, 2)):
        scores.append(f"SELECT {k} AS k, valid, total FROM ({_score_sql(a, b)})")
        plans.append(f"""SELECT {k} AS k, '{a}' AS col, cv, correct_value FROM (SELECT cv, max(pv) FILTER (r = 1) AS correct_value, count(*) AS parents, sum(n) AS present, max(n) FILTER (r = 1) AS top, coalesce(max(n) FILTER (r = 2), 0) AS second
            FROM (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY n DESC, first) AS r FROM (SELECT {b} AS cv, {a} AS pv, count(*) AS n, min(initial_id) AS first FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)) GROUP BY cv)
            WHERE parents > 1 {"AND present >= 5 AND 100.0 * top / present >= CASE WHEN present >= 100 THEN 60 WHEN present >= 50 THEN 65 WHEN present >= 20 THEN 70 WHEN present >= 10 THEN 75 ELSE 80 END AND (second = 0 OR top >= 3.0 * second)" if confident else ""}""")
        rows.append(f"SELECT {k} AS k, initial_id, {a} AS old, {b} AS cv FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    fields = ", ".join(f"coalesce(max(new) FILTER (col = '{c}'), any_value({c})) AS {c}" for c in columns)
    return f"""WITH s AS ({" UNION ALL ".join(scores)}), o AS (SELECT k, row_number() OVER (ORDER BY CASE WHEN valid > 0 THEN 1 - (100.0 * valid / total) / 100 ELSE 1.0 END DESC, k) AS o FROM s WHERE valid < total AND 100.0 * valid / nullif(total, 0) >= {threshold}),
        p AS ({" UNION ALL ".join(plans)}), r AS ({" UNION ALL ".join(rows)}),
        c AS (SELECT initial_id, col, arg_max(correct_value, o) AS new, count(*) AS writes FROM r JOIN p USING (k, cv) JOIN o USING (k) WHERE old <> correct_value GROUP BY ALL)
        SELECT initial_id, {fields}, CAST(coalesce(sum(writes), 0) AS BIGINT) AS writes FROM f LEFT JOIN c USING (initial_id) GROUP BY initial_id"""


def _repaired(confident: bool):
    def run(df: DataFrame) -> DataFrame:
        out, changes = repair.repair_all(df, 20, True, _ALL_PAIRS, confident_only=confident)
        writes = changes.groupBy("initial_id").agg(F.count("*").alias("writes"))
        return out.join(writes, "initial_id", "left").select("initial_id", *_ALL_PAIRS, F.coalesce("writes", F.lit(0)).alias("writes"))

    query(f"repair_all_pairs{'_confident' if confident else ''}", GROUPS, _repair_sql(_ALL_PAIRS, 20, confident))(run)


_repaired(False)
_repaired(True)


# --- profiles and cleaning ---------------------------------------------------


@query("null_profile", ORD, " UNION ALL ".join(f'SELECT \'{c}\' AS "column", count(*) - count({c}) AS nulls, count(*) AS rows, round((count(*) - count({c})) / count(*), 6) AS share FROM f' for c in ("status", "priority", "segment", "price", "nation", "region")))
def null_profile(df: DataFrame) -> DataFrame:
    return pairs.null_profile(df).withColumn("share", F.round("share", 6))


@query("value_frequencies", ORD, "SELECT status AS value, count(*) AS n, min(initial_id) AS first FROM f WHERE status IS NOT NULL GROUP BY status")
def value_frequencies(df: DataFrame) -> DataFrame:
    return pairs.value_frequencies(df, "status")


@query("value_frequencies_with_na", ORD, "SELECT status AS value, count(*) AS n, min(initial_id) AS first FROM f GROUP BY status")
def value_frequencies_with_na(df: DataFrame) -> DataFrame:
    return pairs.value_frequencies(df, "status", with_missing=True)


@query("categorical_columns", ORD, " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS present, count(DISTINCT {c}) AS distinct_values, {'false' if c == 'price' else f'count({c}) > 0 AND (count(DISTINCT {c}) < 0.5 * count({c}) OR count(DISTINCT {c}) < 100)'} AS categorical FROM f""" for c in ("status", "priority", "segment", "price", "nation", "region")))
def categorical_columns(df: DataFrame) -> DataFrame:
    return pairs.categorical(df).drop("kind")


@query("drop_sparse_constant", DIRTY, "SELECT initial_id, name, blank, a, b FROM f")
def drop_sparse_constant(df: DataFrame) -> DataFrame:
    return clean.drop_useless_columns(df)


@query("drop_empty_rows", DIRTY, "SELECT initial_id, a, b FROM f WHERE a IS NOT NULL OR b IS NOT NULL")
def drop_empty_rows(df: DataFrame) -> DataFrame:
    return clean.drop_empty_rows(df.select("initial_id", "a", "b"))


@query("strip_to_null", DIRTY, "SELECT initial_id, nullif(trim(name), '') AS name, nullif(trim(blank), '') AS blank FROM f")
def strip_to_null(df: DataFrame) -> DataFrame:
    return clean.strip_texts(df.select("initial_id", "name", "blank"))


@query("space_counters", DIRTY, """SELECT count(*) FILTER (regexp_matches(name, '^\\s+.+')) + count(*) FILTER (regexp_matches(blank, '^\\s+.+')) AS leading, count(*) FILTER (regexp_matches(name, '^.+\\s+$')) + count(*) FILTER (regexp_matches(blank, '^.+\\s+$')) AS trailing,
    count(*) FILTER (trim(name) = '') + count(*) FILTER (trim(blank) = '') AS blanked FROM f""")  # fmt: skip
def space_counters(df: DataFrame) -> DataFrame:
    return clean.space_counters(df.select("initial_id", "name", "blank"))


@query("clean_import", DIRTY, "SELECT initial_id, nullif(trim(name), '') AS name, nullif(trim(blank), '') AS blank, nullif(trim(a), '') AS a, nullif(trim(b), '') AS b FROM f WHERE NOT (name IS NULL AND blank IS NULL AND a IS NULL AND b IS NULL)")
def clean_import(df: DataFrame) -> DataFrame:
    return clean.clean_import(df)


@query("dedup_rows", DIRTY, "SELECT min(initial_id) AS initial_id, a, b FROM f GROUP BY a, b")
def dedup_rows(df: DataFrame) -> DataFrame:
    return clean.drop_duplicates(df.select("initial_id", "a", "b"))


@query("merge_files_union", DIRTY, "WITH u AS (SELECT a, b, NULL AS blank FROM f WHERE initial_id % 2 = 0 UNION SELECT NULL, b, blank FROM f WHERE initial_id % 2 = 1) SELECT nullif(trim(a), '') AS a, nullif(trim(b), '') AS b, nullif(trim(blank), '') AS blank FROM u")
def merge_files_union(df: DataFrame) -> DataFrame:
    return clean.merge([df.filter("initial_id % 2 = 0").select("initial_id", "a", "b"), df.filter("initial_id % 2 = 1").select("initial_id", "b", "blank")], useless=False)


@query("merged_csv", DIRTY, "WITH u AS (SELECT a, b, NULL AS blank FROM f WHERE initial_id % 2 = 0 UNION SELECT NULL, b, blank FROM f WHERE initial_id % 2 = 1) SELECT nullif(trim(a), '') AS a, nullif(trim(b), '') AS b, nullif(trim(blank), '') AS blank FROM u")
def merged_csv(df: DataFrame) -> DataFrame:
    """Two tables merged in a session, written as CSV without row ids, and read again."""
    merged = Session.merged([df.filter("initial_id % 2 = 0").select("initial_id", "a", "b"), df.filter("initial_id % 2 = 1").select("initial_id", "b", "blank")], useless=False)
    folder = _scratch(df.sparkSession, "merged")
    sinks.write_csv(merged.processed, folder)
    return readers.read_csv(df.sparkSession, folder)


@query("results_after_drop", ORD, f"WITH s AS ({' UNION ALL '.join(_score_sql(a, b) for a, b in permutations(TEXTS, 2))}) SELECT parent, child, valid, total FROM s WHERE 'status' NOT IN (parent, child) AND 'nation' NOT IN (parent, child)")
def results_after_drop(df: DataFrame) -> DataFrame:
    """What a session still knows of its column pairs after two columns are gone."""
    s = Session(df, df)
    for r in pairs.analyse_one_to_many(df, 0, True, TEXTS).collect():  # a row a pair of columns
        s = s.with_result((r.parent, r.child), (r.valid, r.total))
    left = s.drop("status").concat("nation", "price").results
    return df.sparkSession.createDataFrame([(*k, *v) for k, v in left.items()], "parent string, child string, valid long, total long")


@query("concat_columns", ORD, "SELECT initial_id, priority, price, nation, region, coalesce(status, 'nan') || ' | ' || coalesce(segment, 'nan') AS \"status | segment\" FROM f")
def concat_columns(df: DataFrame) -> DataFrame:
    return clean.concat_columns(df, "status", "segment")


_KEYED = "SELECT p_partkey AS key, p_name AS name FROM {part}"


@query("row_numbers", _KEYED, "SELECT row_number() OVER (ORDER BY key DESC) AS initial_id, key FROM f")
def row_numbers(df: DataFrame) -> DataFrame:
    return clean.with_row_id(df.select((-F.col("key")).alias("order"), "key"), ["order"]).select("initial_id", "key")


@query("preview_rows", ORD, "SELECT * FROM f ORDER BY initial_id LIMIT 10")
def preview_rows(df: DataFrame) -> DataFrame:
    return Session(df, df).preview()


@query("listwise_report", ORD, "SELECT count(*) AS rows, count(*) FILTER (status IS NOT NULL AND segment IS NOT NULL AND price IS NOT NULL) AS complete, count(*) - count(status) AS na_status, count(*) - count(segment) AS na_segment, count(*) - count(price) AS na_price FROM f")
def listwise_report(df: DataFrame) -> DataFrame:
    return covariance.missing_report(df, ["status", "segment", "price"])


@query("short_labels", _KEYED, "SELECT key, CASE WHEN length(name) > 12 THEN substr(name, 1, 9) || '...' ELSE name END AS label FROM f")
def short_labels(df: DataFrame) -> DataFrame:
    return df.select("key", shorten(F.col("name"), 12).alias("label"))


# --- imputation --------------------------------------------------------------


@query("conditional_numeric_stats", ORD, """WITH r AS (SELECT segment, status, price FROM f WHERE segment IS NOT NULL AND status IS NOT NULL AND price IS NOT NULL),
    k AS (SELECT segment, status, price, count(*) AS c FROM r GROUP BY ALL), m AS (SELECT segment, status, price, row_number() OVER (PARTITION BY segment, status ORDER BY c DESC, price) AS r FROM k)
    SELECT segment, status, n, mean, median, round(price, 4) AS mode, std FROM (SELECT segment, status, count(*) AS n, round(avg(price), 4) AS mean, round(median(price), 4) AS median, round(coalesce(stddev_samp(price), 0), 4) AS std FROM r GROUP BY ALL) JOIN m USING (segment, status) WHERE r = 1""")  # fmt: skip
def conditional_numeric_stats(df: DataFrame) -> DataFrame:
    return impute.numeric_stats(df, "price", ["segment", "status"]).select("segment", "status", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "mode", "std")))


@query("conditional_categorical_probs", ORD, "WITH r AS (SELECT region, segment, status AS value, count(*) AS n, min(initial_id) AS first FROM f WHERE region IS NOT NULL AND segment IS NOT NULL AND status IS NOT NULL GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY region, segment) AS BIGINT) AS group_n, round(n / sum(n) OVER (PARTITION BY region, segment), 6) AS probability FROM r")
def conditional_categorical_probs(df: DataFrame) -> DataFrame:
    return impute.value_shares(df, "status", ["region", "segment"]).withColumn("probability", F.round("probability", 6))


_MI_FEATURES = ("priority", "segment", "nation", "region")


def _mi_sql(target: str, feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, greatest(0, sum(n / t * ln(n * t / (CAST(a AS DOUBLE) * b)))) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS a, sum(n) OVER (PARTITION BY y) AS b
        FROM (SELECT {target} AS x, {feature} AS y, CAST(count(*) AS DOUBLE) AS n FROM f WHERE {target} IS NOT NULL AND {feature} IS NOT NULL GROUP BY ALL))"""


@query("mutual_information_discrete", ORD, f"WITH m AS ({' UNION ALL '.join(_mi_sql('status', x) for x in _MI_FEATURES)}) SELECT feature, round(mi, 6) AS mi FROM m")
def mutual_information_discrete(df: DataFrame) -> DataFrame:
    return impute.mutual_information(df, "status", _MI_FEATURES).withColumn("mi", F.round("mi", 6))


_PRODUCTS = """SELECT p_partkey AS initial_id, p_retailprice AS price, p_size AS size, p_brand AS brand,
    CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_retailprice / 100.0 + 20 * p_size END AS mixed FROM {part}"""


def _noise_sql(salt: int) -> str:
    return f"CAST('0x' || substr(md5(initial_id || '/{salt}'), 1, 6) AS BIGINT)"


def _psi(n: str) -> str:
    x = f"(CAST({n} AS DOUBLE) + 6)"
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6)" + "".join(f" - 1 / (CAST({n} AS DOUBLE) + {j})" for j in range(6)) + ")"


def _neighbour_sql(name: str) -> str:
    """All pairs of rows: the third distance of each row, and the rows nearer than it along either column."""
    return f"""SELECT '{name}' AS feature, greatest(0, {_psi('max(n)')} + {_psi('3')} - avg({_psi('nx')}) - avg({_psi('ny')})) AS mi FROM (SELECT i, count(*) FILTER (dx < r) + 1 AS nx, count(*) FILTER (dy < r) + 1 AS ny, any_value(n) AS n FROM
        (SELECT *, max(d) FILTER (k = 3) OVER (PARTITION BY i) AS r FROM (SELECT *, greatest(dx, dy) AS d, row_number() OVER (PARTITION BY i ORDER BY greatest(dx, dy)) AS k FROM
        (SELECT p.initial_id AS i, p.n AS n, abs(p.x - q.x) AS dx, abs(p.y - q.y) AS dy FROM {name}_v p JOIN {name}_v q ON p.initial_id <> q.initial_id))) GROUP BY i)"""


_NEAR = ("size", "mixed")
_NEAR_SQL = ", ".join(f"{c}_v AS MATERIALIZED (SELECT initial_id, count(*) OVER () AS n, CAST(floor(price / stddev_pop(price) OVER () * 1048576) AS BIGINT) * 16777216 + {_noise_sql(1)} AS x, CAST(floor({c} / stddev_pop({c}) OVER () * 1048576) AS BIGINT) * 16777216 + {_noise_sql(2)} AS y FROM f WHERE price IS NOT NULL AND {c} IS NOT NULL)" for c in _NEAR)


@query("mutual_information_neighbours", _PRODUCTS, f"WITH {_NEAR_SQL} SELECT feature, round(mi, 4) AS mi FROM ({' UNION ALL '.join(_neighbour_sql(c) for c in _NEAR)})")
def mutual_information_neighbours(df: DataFrame) -> DataFrame:
    return impute.mutual_information(df, "price", _NEAR, "neighbours").withColumn("mi", F.round("mi", 4))


@query("mutual_information_lines", LINES)
def mutual_information_lines(df: DataFrame) -> DataFrame:
    """The same over all lines, of the quantity; and of the classes of flags."""
    numbers = impute.mutual_information(df, "quantity", ["discount", "tax", "flag"], "neighbours").withColumn("target", F.lit("quantity"))
    return numbers.unionByName(impute.mutual_information(df, "flag", ["quantity", "line"], "neighbours").withColumn("target", F.lit("flag")))


@query("fill_na_single", ORD, f"""WITH m AS ({' UNION ALL '.join(_mi_sql('status', x) for x in ('nation', 'region'))}), s AS (SELECT avg(mi) AS mean_mi, max(mi) AS max_mi FROM m),
    c AS (SELECT nation, region, status, count(*) AS n, min(initial_id) AS first FROM f WHERE status IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY nation, region) AS total, row_number() OVER (PARTITION BY nation, region ORDER BY n DESC, first) AS r FROM c),
    p AS (SELECT nation, region, status AS value, n / total AS probability, total FROM r WHERE r = 1)
    SELECT initial_id, value AS prediction, round(probability, 6) AS probability, round(least(1, greatest(0, 0.4 * probability + 0.3 * CASE WHEN max_mi > 0 THEN mean_mi / max_mi ELSE 0 END + 0.3 * least(1, log10(greatest(total, 1)) / 2))), 6) AS confidence
    FROM (SELECT * FROM f WHERE status IS NULL) JOIN p USING (nation, region), s
    WHERE 0.4 * probability + 0.3 * CASE WHEN max_mi > 0 THEN mean_mi / max_mi ELSE 0 END + 0.3 * least(1, log10(greatest(total, 1)) / 2) >= 0.5""")  # fmt: skip
def fill_na_single(df: DataFrame) -> DataFrame:
    keys, mean_mi, max_mi = impute.top_features(impute.mutual_information(df, "status", ["nation", "region"]).collect(), 2)
    out = impute.fills(df, "status", sorted(keys), mean_mi, max_mi)
    return out.select("initial_id", "prediction", F.round("probability", 6).alias("probability"), F.round("confidence", 6).alias("confidence"))


@query("fill_na_all", ORD)
def fill_na_all(df: DataFrame) -> DataFrame:
    return impute.fill_all(df)


@query("predicted_numbers", ORD, """SELECT status, round(median(price), 4) AS prediction, round(1 / (1 + coalesce(stddev_samp(price), 0)), 9) AS probability, count(*) AS n FROM f WHERE status IS NOT NULL AND price IS NOT NULL GROUP BY status""")
def predicted_numbers(df: DataFrame) -> DataFrame:
    return impute.predictions(df, "price", ["status"]).select("status", F.round("prediction", 4).alias("prediction"), F.round("probability", 9).alias("probability"), "n")


_FILLED = ("status", "segment", "nation", "region")


def _mean_mi(target: str) -> str:
    each = " UNION ALL ".join(_mi_sql(target, x) for x in _FILLED if x != target)
    return f"mi_{target} AS (SELECT *, row_number() OVER (ORDER BY mi DESC) AS r FROM ({each})), m_{target} AS (SELECT avg(mi) AS mean_mi, max(mi) AS max_mi FROM mi_{target})"


def _fill_sql(source: str, target: str) -> str:
    """``target`` of ``source`` filled from the groups of all other columns."""
    keys = ", ".join(c for c in _FILLED if c != target)
    present = " AND ".join(f"{c} IS NOT NULL" for c in _FILLED if c != target)
    sure = "0.4 * n / total + 0.3 * CASE WHEN max_mi > 0 THEN mean_mi / max_mi ELSE 0 END + 0.3 * least(1, log10(greatest(total, 1)) / 2)"
    shown = ", ".join(f"coalesce({c}, CASE WHEN {sure} >= 0.5 THEN best END) AS {c}" if c == target else c for c in _FILLED)
    return f"""(SELECT initial_id, {shown} FROM {source} LEFT JOIN (SELECT {keys}, {target} AS best, n, total FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS total, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS r
        FROM (SELECT {keys}, {target}, count(*) AS n, min(initial_id) AS first FROM {source} WHERE {target} IS NOT NULL AND {present} GROUP BY ALL)) WHERE r = 1) USING ({keys}), m_{target})"""


@query("fill_na_in_order", ORD, f"WITH {_mean_mi('status')}, {_mean_mi('segment')}, one AS {_fill_sql('f', 'status')}, two AS {_fill_sql('one', 'segment')} SELECT * FROM two")
def fill_na_in_order(df: DataFrame) -> DataFrame:
    """Two columns with missing values, the second filled from groups that hold the first's fills."""
    return impute.fill_all(df.select("initial_id", *_FILLED))


@query("fill_na_analysis", ORD, f"""WITH {_mean_mi('status')}, k AS (SELECT DISTINCT segment, nation, region FROM f WHERE status IS NOT NULL AND segment IS NOT NULL)
    SELECT 'status' AS target, string_agg(feature, ',' ORDER BY r) AS columns, round(avg(mi), 6) AS mean_mi, round(max(mi), 6) AS max_mi, (SELECT count(*) FROM f WHERE status IS NULL) AS na_count, (SELECT count(*) FROM f JOIN k USING (segment, nation, region) WHERE f.status IS NULL) AS fillable_count FROM mi_status""")  # fmt: skip
def fill_na_analysis(df: DataFrame) -> DataFrame:
    a = impute.analyse(df.select("initial_id", *_FILLED), "status", 3)
    row = (a["target"], ",".join(a["columns"]), round(a["mean_mi"], 6), round(a["max_mi"], 6), a["na_count"], a["fillable_count"])
    return df.sparkSession.createDataFrame([row], "target string, columns string, mean_mi double, max_mi double, na_count long, fillable_count long")


# --- rules -------------------------------------------------------------------

_ITEM = "'{c}=' || coalesce({c}, 'NA')"
_BASKET = "t AS (SELECT initial_id, unnest([" + ", ".join(_ITEM.format(c=c) for c in ("status", "segment", "region")) + "]) AS i FROM f), n AS (SELECT count(DISTINCT initial_id) AS total FROM t)"
_ONE = "i1 AS (SELECT i AS items, 1 AS size, count(*) AS freq, count(*) / any_value(total) AS support FROM t, n GROUP BY i HAVING count(*) >= 0.05 * any_value(total))"
_TWO = "i2 AS (SELECT x.i || '|' || y.i AS items, 2 AS size, count(*) AS freq, count(*) / any_value(total) AS support FROM t x JOIN t y ON x.initial_id = y.initial_id AND x.i < y.i, n GROUP BY x.i, y.i HAVING count(*) >= 0.05 * any_value(total))"
_THREE = "i3 AS (SELECT x.i || '|' || y.i || '|' || z.i AS items, 3 AS size, count(*) AS freq, count(*) / any_value(total) AS support FROM t x JOIN t y ON x.initial_id = y.initial_id AND x.i < y.i JOIN t z ON x.initial_id = z.initial_id AND y.i < z.i, n GROUP BY x.i, y.i, z.i HAVING count(*) >= 0.05 * any_value(total))"
_SETS = f"{_BASKET}, {_ONE}, {_TWO}, {_THREE}, sets AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3)"
_RULES = f"""{_SETS}, big AS (SELECT string_split(items, '|') AS l, support FROM sets WHERE size > 1),
    masks AS (SELECT l, support, unnest(range(1, (1 << len(l)) - 1)) AS m FROM big),
    split AS (SELECT support, array_to_string([l[k] FOR k IN range(1, len(l) + 1) IF (m >> (k - 1)) & 1 = 1], '|') AS antecedent, array_to_string([l[k] FOR k IN range(1, len(l) + 1) IF (m >> (k - 1)) & 1 = 0], '|') AS consequent FROM masks),
    rules AS (SELECT antecedent, consequent, split.support, split.support / a.support AS confidence, split.support / a.support / c.support AS lift FROM split JOIN sets a ON a.items = antecedent JOIN sets c ON c.items = consequent WHERE split.support / a.support >= 0.2)"""


def _baskets(df: DataFrame) -> DataFrame:
    return assoc.transactions(df, ["status", "segment", "region"])


def _joined(*names: str) -> list:
    return [F.array_join(n, "|").alias(n) for n in names]


def _rules(df: DataFrame) -> DataFrame:
    return assoc.association_rules(assoc.frequent_itemsets(_baskets(df), 0.05, 3), 0.2)


@query("transactions", ORD, f"WITH {_BASKET} SELECT initial_id, string_agg(i, '|' ORDER BY i) AS items FROM t GROUP BY initial_id")
def transactions(df: DataFrame) -> DataFrame:
    return _baskets(df).select("initial_id", *_joined("items"))


def _itemsets(size: int):
    least = 0.01 if size == 3 else 0.05

    def run(df: DataFrame) -> DataFrame:
        return assoc.frequent_itemsets(_baskets(df), least, size).filter(F.col("size") == size).select(*_joined("items"), "size", "freq", F.round("support", 6).alias("support"))

    query(f"itemsets_{size}", ORD, f"WITH {_SETS.replace('0.05', str(least))} SELECT items, size, freq, round(support, 6) AS support FROM i{size}")(run)


for _size in (1, 2, 3):
    _itemsets(_size)



@query("itemsets_ranked", ORD, f"WITH {_SETS} SELECT row_number() OVER (ORDER BY size, support DESC, items) - 1 AS place, items FROM sets")
def itemsets_ranked(df: DataFrame) -> DataFrame:
    return _placed(assoc.sort_itemsets(assoc.frequent_itemsets(_baskets(df), 0.05, 3)), *_joined("items"))


_SHOWN = "antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift"


@query("association_rules", ORD, f"WITH {_RULES} SELECT {_SHOWN} FROM rules")
def association_rules(df: DataFrame) -> DataFrame:
    return _rules(df).select(*_joined("antecedent", "consequent"), *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")))


@query("rules_mined", ORD, f"WITH {_RULES} SELECT {_SHOWN} FROM rules")
def rules_mined(df: DataFrame) -> DataFrame:
    _, rules = assoc.mine(df, ["status", "segment", "region"], 0.05, 0.2, 3)
    return rules.select(*_joined("antecedent", "consequent"), *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")))


@query("rules_filtered_sorted", ORD, f"WITH {_RULES} SELECT row_number() OVER (ORDER BY round(lift, 9) DESC, antecedent, consequent) - 1 AS place, {_SHOWN} FROM rules WHERE lift BETWEEN 0.9 AND 1.2 AND len(string_split(antecedent, '|')) = 1 AND list_has_any(list_transform(list_concat(string_split(antecedent, '|'), string_split(consequent, '|')), lambda x: lower(x)), ['region=asia', 'status=f'])")
def rules_filtered_sorted(df: DataFrame) -> DataFrame:
    rules = _rules(df).withColumn("lift", F.round("lift", 9))  # sums of doubles differ in their last digits
    out = assoc.sort_rules(assoc.filter_rules(rules, lift=(0.9, 1.2), antecedent_size=(1, 1), search="REGION=ASIA, status=f"), "lift")
    return _placed(out, "antecedent", "consequent", "support", "confidence", "lift").select("place", *_joined("antecedent", "consequent"), *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")))


@query("rule_statistics", ORD, f"WITH {_RULES} SELECT count(*) AS rules, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("confidence", "lift") for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))) + " FROM rules")
def rule_statistics(df: DataFrame) -> DataFrame:
    out = assoc.rule_statistics(_rules(df))
    return out.select("rules", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("rule_graph_edges", ORD, f"WITH {_RULES}, e AS (SELECT unnest(string_split(antecedent, '|')) AS source, consequent, confidence FROM rules), g AS (SELECT source, unnest(string_split(consequent, '|')) AS target, confidence FROM e), w AS (SELECT source, target, max(confidence) AS weight FROM g GROUP BY ALL) SELECT source, target, round(weight, 6) AS weight, round(coalesce((weight - min(weight) OVER ()) / nullif(max(weight) OVER () - min(weight) OVER (), 0), 0) * 3 + 0.5, 6) AS width FROM w")
def rule_graph_edges(df: DataFrame) -> DataFrame:
    return assoc.rule_edges(_rules(df)).select("source", "target", F.round("weight", 6).alias("weight"), F.round("width", 6).alias("width"))


def _bins(method: str):
    def run(df: DataFrame) -> DataFrame:
        cuts = assoc.edges(df, "quantity", 5, method)
        return df.groupBy(assoc.bin_label(F.col("quantity"), cuts, method).alias("bin")).agg(F.count("*").alias("n"), F.min("quantity").alias("low"), F.max("quantity").alias("high")).drop("bin")

    cut = "quantile_cont(quantity, {q})" if method == "quantile" else "min(quantity) + (max(quantity) - min(quantity)) * {q}"
    cuts = ", ".join(cut.format(q=q) + f" AS q{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8), 1))
    query(f"{method}_bins", LINES, f"WITH c AS (SELECT {cuts} FROM f) SELECT count(*) AS n, min(quantity) AS low, max(quantity) AS high FROM f, c GROUP BY CASE WHEN quantity <= q1 THEN 1 WHEN quantity <= q2 THEN 2 WHEN quantity <= q3 THEN 3 WHEN quantity <= q4 THEN 4 ELSE 5 END")(run)


_bins("quantile")
_bins("uniform")


# --- covariance --------------------------------------------------------------

_NUMBERS = ("quantity", "discount", "tax")


@query("zscore_features", LINES, "SELECT initial_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in _NUMBERS) + " FROM f")
def zscore_features(df: DataFrame) -> DataFrame:
    return covariance.zscores(df, _NUMBERS).select("initial_id", *(F.round(c, 4).alias(c) for c in _NUMBERS))


_COV = " UNION ALL ".join(f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, covar_samp({a}, {b}) AS cov FROM f" for a in _NUMBERS for b in _NUMBERS)


@query("covariance_matrix", LINES, f"WITH c AS ({_COV}) SELECT feature_i, feature_j, round(cov, 6) AS cov FROM c")
def covariance_matrix(df: DataFrame) -> DataFrame:
    return covariance.covariance(df, _NUMBERS).withColumn("cov", F.round("cov", 6))


@query("covariance_summary", LINES, f'WITH c AS ({_COV}) SELECT round(min(cov), 6) AS "min", round(max(cov), 6) AS "max", round(avg(cov), 6) AS "mean", round(stddev_pop(cov), 6) AS "std" FROM c')
def covariance_summary(df: DataFrame) -> DataFrame:
    return covariance.summary(covariance.covariance(df, _NUMBERS)).select(*(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")))


@query("frequency_encoding", ORD, "SELECT initial_id, round(count(*) OVER (PARTITION BY coalesce(segment, '_MISSING_')) / count(*) OVER (), 6) AS segment FROM f")
def frequency_encoding(df: DataFrame) -> DataFrame:
    return covariance.frequency_encoding(df.select("initial_id", "segment"), ["segment"]).select("initial_id", F.round("segment", 6).alias("segment"))


@query("mca_covariance_cluster", ORD)
def mca_covariance_cluster(df: DataFrame) -> DataFrame:
    out = covariance.analyse(df, ["status", "priority", "segment", "price", "region"], refine=True)
    place = F.array_position(F.array(*map(F.lit, out["order"])), F.col("feature_i"))
    return out["covariance"].withColumn("place", place)


# --- the graph of columns ----------------------------------------------------

_NATION = "SELECT n_nationkey AS initial_id, n_nationkey AS key, n_name AS name, n_regionkey AS region_key, r_name AS region FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
_NODES = ("key", "name", "region_key", "region")
_EDGES = f"s AS ({' UNION ALL '.join(_score_sql(a, b) for a, b in permutations(_NODES, 2))}), e AS (SELECT parent AS src, child AS dst FROM s WHERE valid = total)"


def _edges(df: DataFrame) -> DataFrame:
    return relations.edges_of(pairs.analyse_one_to_many(df, 95, True, _NODES), df.columns)


@query("relation_edges_reduced", _NATION, f"""WITH {_EDGES}, both_ways AS (SELECT src, dst FROM e WHERE (dst, src) IN (SELECT (src, dst) FROM e) AND src < dst), one AS (SELECT src, dst FROM e WHERE (dst, src) NOT IN (SELECT (src, dst) FROM e)),
    kept AS (SELECT src, dst FROM one WHERE NOT EXISTS (SELECT 1 FROM one a JOIN one b ON a.dst = b.src WHERE a.src = one.src AND b.dst = one.dst)) SELECT src, dst FROM kept UNION ALL SELECT src, dst FROM both_ways""")  # fmt: skip
def relation_edges_reduced(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(relations.reduced(_edges(df)), "src string, dst string")


@query("relation_edges_removed", _NATION, f"""WITH {_EDGES}, one AS (SELECT src, dst FROM e WHERE (dst, src) NOT IN (SELECT (src, dst) FROM e)),
    kept AS (SELECT src, dst FROM one WHERE NOT EXISTS (SELECT 1 FROM one a JOIN one b ON a.dst = b.src WHERE a.src = one.src AND b.dst = one.dst))
    SELECT src, dst FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM kept) AND NOT ((dst, src) IN (SELECT (src, dst) FROM e) AND src < dst)""")  # fmt: skip
def relation_edges_removed(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(relations.removed(_edges(df)), "src string, dst string")


@query("relation_graph_stats", _NATION, f"""WITH {_EDGES}, n AS (SELECT src AS x FROM e UNION SELECT dst FROM e), d AS (SELECT x, (SELECT count(*) FROM e WHERE src = x) AS o, (SELECT count(*) FROM e WHERE dst = x) AS i FROM n)
    SELECT count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, count(*) FILTER (i = 0) AS roots, count(*) FILTER (o = 0) AS leaves, count(*) FILTER (i > 1) AS many_parents, count(*) FILTER (o > 1) AS many_children, NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.dst = b.src AND a.src = b.dst) AS acyclic FROM d""")  # fmt: skip
def relation_graph_stats(df: DataFrame) -> DataFrame:
    return relations.graph_statistics(_edges(df))


@query("relation_colors", ORD, f"""WITH s AS ({' UNION ALL '.join(_score_sql(a, b) for a, b in permutations(TEXTS, 2))}), v AS (SELECT parent AS src, child AS dst, CASE WHEN valid > 0 THEN 1 - (100.0 * valid / total) / 100 ELSE 1.0 END AS r FROM s)
    SELECT src, dst, CASE WHEN r <= 0 THEN '#00FF00' WHEN r >= 0.05 THEN '#FF0000' ELSE printf('#%02X%02X%02X', CAST(trunc(255 * (r / 0.05)) AS INT), CAST(trunc(255 - 255 * (r / 0.05)) AS INT), 0) END AS color FROM v""")  # fmt: skip
def relation_colors(df: DataFrame) -> DataFrame:
    return relations.colored_edges(relations.edges_of(pairs.analyse_one_to_many(df, 0, True, TEXTS), TEXTS)).select("src", "dst", "color")


_NODE_SHARES = " UNION ALL ".join(f"SELECT '{c}' AS node, (count(*) - count({c})) / count(*) AS share FROM f" for c in (*TEXTS, "price")) + " UNION ALL SELECT 'other', 0.0"
_RGB = "printf('#%02X%02X%02X', CAST(trunc({0}) AS INT), CAST(trunc({1}) AS INT), CAST(trunc({2}) AS INT))"


@query("missing_colors", ORD, f"""WITH s AS ({_NODE_SHARES}) SELECT node, round(share, 6) AS share, CASE WHEN share = 0 THEN '#006400' WHEN share >= 0.5 THEN '#8B0000'
    WHEN share <= 0.15 THEN {_RGB.format('139 * (share / 0.15)', '100 - 31 * (share / 0.15)', '19 * (share / 0.15)')} ELSE {_RGB.format('139', '69 - 69 * ((share - 0.15) / 0.35)', '19 - 19 * ((share - 0.15) / 0.35)')} END AS color FROM s""")  # fmt: skip
def missing_colors(df: DataFrame) -> DataFrame:
    nodes = df.sparkSession.createDataFrame([(c,) for c in (*TEXTS, "price", "other")], "node string")
    return relations.colored_nodes(nodes, pairs.null_profile(df)).withColumn("share", F.round("share", 6))


#: A graph of parts: each has edges to its half, its third and its sixth, of which the last follows from the others.
_PART_GRAPH = "SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS dst FROM {part} UNION ALL SELECT p_partkey, CAST(FLOOR(p_partkey / 3.0) AS BIGINT) FROM {part} UNION ALL SELECT p_partkey, CAST(FLOOR(p_partkey / 6.0) AS BIGINT) FROM {part}) WHERE dst > 0"
_REACH = "RECURSIVE c AS (SELECT src, dst FROM f UNION SELECT c.src, f.dst FROM c JOIN f ON c.dst = f.src)"
_DETOUR = "EXISTS (SELECT 1 FROM f x JOIN c ON x.dst = c.src WHERE x.src = f.src AND c.dst = f.dst)"


@query("graph_closure", _PART_GRAPH, "WITH RECURSIVE c AS (SELECT src, dst, 1 AS steps FROM f UNION SELECT c.src, f.dst, c.steps + 1 FROM c JOIN f ON c.dst = f.src) SELECT src, dst, CAST(min(steps) AS INT) AS steps FROM c GROUP BY ALL")
def graph_closure(df: DataFrame) -> DataFrame:
    return graphs.closure(df)


@query("graph_reduced", _PART_GRAPH, f"WITH {_REACH} SELECT src, dst FROM f WHERE NOT {_DETOUR}")
def graph_reduced(df: DataFrame) -> DataFrame:
    return graphs.reduced(df)


@query("graph_removed", _PART_GRAPH, f"""WITH {_REACH}, k AS (SELECT src, dst FROM f WHERE NOT {_DETOUR}), g AS (SELECT src, dst FROM f WHERE {_DETOUR}),
    w AS (SELECT src, dst AS at, [src, dst] AS path FROM k UNION ALL SELECT w.src, k.dst, list_append(path, k.dst) FROM w JOIN k ON w.at = k.src)
    SELECT src, dst, array_to_string(path, '>') AS path FROM (SELECT g.src, g.dst, path, row_number() OVER (PARTITION BY g.src, g.dst ORDER BY len(path), path) AS r FROM g JOIN w ON w.src = g.src AND w.at = g.dst) WHERE r = 1""")  # fmt: skip
def graph_removed(df: DataFrame) -> DataFrame:
    return graphs.removed(df).select("src", "dst", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


# --- trees -------------------------------------------------------------------

_TREE = ("status", "segment", "region")


@query("value_tree", ORD, """WITH r AS (SELECT coalesce(status, '<NA>') AS status, coalesce(segment, '<NA>') AS segment, coalesce(region, '<NA>') AS region, initial_id FROM f WHERE region = 'ASIA'),
    c AS (SELECT 'status' AS col, 0 AS o, status AS value, count(*) AS n, min(initial_id) AS first FROM r GROUP BY status UNION ALL SELECT 'segment', 1, segment, count(*), min(initial_id) FROM r GROUP BY segment),
    b AS (SELECT col FROM c GROUP BY col, o ORDER BY max(n) / sum(n) / (1 + 0.1 * greatest(0, count(*) - 2)) DESC, o LIMIT 1), l AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS k FROM c WHERE col = (SELECT col FROM b))
    SELECT col AS "column", value, n AS "count", round(n / (SELECT count(*) FROM r), 6) AS probability FROM l WHERE k <= 5""")  # fmt: skip
def value_tree(df: DataFrame) -> DataFrame:
    out = valuetree.trees(df.select("initial_id", *_TREE), "region", ["ASIA"], max_depth=1, exclude_id=False)
    return out.filter("depth = 1").select("column", "value", "count", F.round("probability", 6).alias("probability"))


def _tree_sql(columns: tuple[str, ...], root: str, depth: int, least: float, most: int) -> str:
    """The tree of all values of ``root``, level by level."""
    steps = [f"r0 AS (SELECT {root} AS node, {root} AS root, ['{root}'] AS used, {', '.join(columns)} FROM b)"]
    for d in range(1, depth + 1):
        cells = " UNION ALL ".join(f"SELECT node, root, '{c}' AS col, {i} AS o, {c} AS value FROM r{d - 1} WHERE NOT list_contains(used, '{c}')" for i, c in enumerate(columns))
        steps.append(f"c{d} AS (SELECT node, root, col, o, value, count(*) AS n FROM ({cells}) GROUP BY ALL)")
        steps.append(f"p{d} AS (SELECT node, col, sum(n) AS total, row_number() OVER (PARTITION BY node ORDER BY max(n) / sum(n) / (1 + 0.10 * greatest(0, count(*) - 2)) DESC, o) AS k FROM c{d} GROUP BY node, col, o)")
        steps.append(f"l{d} AS (SELECT c.node || chr(31) || col || '=' || value AS node_id, c.node AS parent_id, root, {d} AS depth, col, value, n, n / total AS probability FROM (SELECT c.*, total, row_number() OVER (PARTITION BY c.node ORDER BY n DESC, value) AS r FROM c{d} c JOIN p{d} p USING (node, col) WHERE k = 1) c WHERE r <= {most} AND n / total >= {least})")
        now = "CASE l.col " + " ".join(f"WHEN '{c}' THEN r.{c}" for c in columns) + " END"
        steps.append(f"r{d} AS (SELECT node_id AS node, r.root, list_append(used, col) AS used, {', '.join(f'r.{c}' for c in columns)} FROM r{d - 1} r JOIN l{d} l ON r.node = l.parent_id AND {now} = l.value)")
    start = f"SELECT {root} AS node_id, NULL AS parent_id, {root} AS root, 0 AS depth, '{root}' AS col, {root} AS value, count(*) AS n, 1.0 AS probability FROM b GROUP BY {root}"
    rows = " UNION ALL ".join([start, *(f"SELECT * FROM l{d}" for d in range(1, depth + 1))])
    filled = ", ".join("coalesce(" + c + ", '<NA>') AS " + c for c in columns)
    base = f"b AS (SELECT {filled} FROM f)"
    return f'WITH {base}, {", ".join(steps)} SELECT node_id, parent_id, root, CAST(depth AS INT) AS depth, col AS "column", value, n AS "count", round(probability, 6) AS probability FROM ({rows})'


@query("value_tree_top15", ORD, _tree_sql((*_TREE, "priority"), "region", 3, 0.05, 10))
def value_tree_top15(df: DataFrame) -> DataFrame:
    rows = df.select("initial_id", *_TREE, "priority")
    return valuetree.trees(rows, "region", valuetree.top_values(rows, "region"), max_depth=3, min_probability=0.05, max_values=10, exclude_id=True).withColumn("probability", F.round("probability", 6))


_SHOWN_TREE = _tree_sql((*_TREE, "priority"), "region", 2, 0.05, 4)


@query("value_tree_text", ORD, f"""WITH RECURSIVE t AS ({_SHOWN_TREE}), r AS (SELECT *, printf('%08x', row_number() OVER (PARTITION BY parent_id ORDER BY probability DESC, value)) AS place FROM t),
    k AS (SELECT node_id, place AS key FROM r WHERE depth = 0 UNION ALL SELECT r.node_id, k.key || r.place FROM r JOIN k ON r.parent_id = k.node_id)
    SELECT row_number() OVER (ORDER BY key) - 1 AS place, repeat('  ', depth) || "column" || ' = ' || value || ' (' || printf('%.2f', probability * 100) || '%, ' || "count" || ')' AS line FROM r JOIN k USING (node_id)""")  # fmt: skip
def value_tree_text(df: DataFrame) -> DataFrame:
    rows = df.select("initial_id", *_TREE, "priority")
    nodes = valuetree.trees(rows, "region", valuetree.top_values(rows, "region"), max_depth=2, min_probability=0.05, max_values=4, exclude_id=True)
    return _placed(valuetree.lines(nodes.withColumn("probability", F.round("probability", 6))), "line")


# --- mappings, batches, model calls --------------------------------------------

_PART = "SELECT p_partkey AS initial_id, p_type AS kind, p_brand AS brand FROM {part}"
_MAPPING = "m AS (SELECT DISTINCT kind AS original, upper(split_part(kind, ' ', 1)) AS simplified FROM f WHERE kind <> 'PROMO'), a AS (SELECT initial_id, kind, coalesce(simplified, kind) AS kind_simplified FROM f LEFT JOIN m ON kind = original)"


def _mapped(df: DataFrame) -> DataFrame:
    return batches.simplify(df, "kind", _scratch(df.sparkSession, "simplified"))[0]


@query("mapping_apply", _PART, f"WITH {_MAPPING} SELECT initial_id, kind, kind_simplified FROM a")
def mapping_apply(df: DataFrame) -> DataFrame:
    return _mapped(df).select("initial_id", "kind", "kind_simplified")


@query("mapping_preview", _PART, f"WITH {_MAPPING} SELECT row_number() OVER (ORDER BY kind) - 1 AS place, kind, kind_simplified FROM (SELECT DISTINCT kind, kind_simplified FROM a)")
def mapping_preview(df: DataFrame) -> DataFrame:
    return _placed(batches.mapping_preview(_mapped(df), "kind"), "kind", "kind_simplified")


@query("mapping_reduction", _PART, f"WITH {_MAPPING} SELECT count(DISTINCT kind) AS before, count(DISTINCT kind_simplified) AS after, count(DISTINCT kind) - count(DISTINCT kind_simplified) AS fewer, round(100.0 * (count(DISTINCT kind) - count(DISTINCT kind_simplified)) / count(DISTINCT kind), 6) AS percent FROM a")
def mapping_reduction(df: DataFrame) -> DataFrame:
    return batches.reduction(_mapped(df), "kind").withColumn("percent", F.round("percent", 6))


@query("batch_fixed10", ORD, "SELECT initial_id, CAST((row_number() OVER (ORDER BY initial_id) - 1) // 10 + 1 AS BIGINT) AS batch_id, CAST((row_number() OVER (ORDER BY initial_id) - 1) % 10 + 1 AS INT) AS local_id FROM f")
def batch_fixed10(df: DataFrame) -> DataFrame:
    return batches.fixed(df).select("initial_id", "batch_id", "local_id")


def _batches_sql(group: str) -> str:
    """Blocks of 50 rows a group, in order, folded into batches: ``placed`` has the rows with their batch."""
    joins = "fold.size < 35 AND fold.size + b.n <= 50"
    return f"""WITH RECURSIVE rows_ AS (SELECT *, (row_number() OVER (PARTITION BY {group} ORDER BY initial_id) - 1) // 50 AS block FROM f WHERE {group} IS NOT NULL),
        blocks AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY g, block) AS k FROM (SELECT {group} AS g, block, count(*) AS n FROM rows_ GROUP BY ALL)),
        fold AS (SELECT k, CAST(1 AS BIGINT) AS batch_id, n AS size FROM blocks WHERE k = 1 UNION ALL SELECT b.k, CASE WHEN {joins} THEN batch_id ELSE batch_id + 1 END, CASE WHEN {joins} THEN fold.size + b.n ELSE b.n END FROM fold JOIN blocks b ON b.k = fold.k + 1),
        placed AS (SELECT rows_.*, batch_id FROM rows_ JOIN blocks ON {group} = g AND rows_.block = blocks.block JOIN fold USING (k))"""


@query("batch_by_group", ORD, f"{_batches_sql('nation')} SELECT initial_id, nation, batch_id FROM placed")
def batch_by_group(df: DataFrame) -> DataFrame:
    return batches.by_group(df, "nation").select("initial_id", "nation", "batch_id")


@query("batch_first_letter", _PART, "SELECT initial_id, upper(substr(kind, 1, 1)) AS batch_id FROM f WHERE trim(kind) <> ''")
def batch_first_letter(df: DataFrame) -> DataFrame:
    return batches.by_first_letter(df, "kind").select("initial_id", "batch_id")


_DOCS = "SELECT doc_id AS initial_id, lang, source, n_chars FROM {documents}"


@query("row_to_string", _DOCS, "SELECT initial_id, initial_id || ' ' || lang || ' ' || source || ' ' || n_chars AS line FROM f")
def row_to_string(df: DataFrame) -> DataFrame:
    return df.select("initial_id", batches.row_line(["lang", "source", "n_chars"]).alias("line"))


@query("product_codes", _PART, "SELECT initial_id, kind, upper(string_split(kind, ' ')[1]) AS product_code FROM f")
def product_codes(df: DataFrame) -> DataFrame:
    return batches.label_rows(df, ["kind", "brand"], "product_code", batches.CODE_PROMPT, _scratch(df.sparkSession, "codes")).select("initial_id", "kind", "product_code")


@query("product_categories", _PART, "SELECT initial_id, kind, string_split(kind, ' ')[-1] AS product_category FROM f")
def product_categories(df: DataFrame) -> DataFrame:
    return batches.label_rows(df, ["brand", "kind"], "product_category", batches.CATEGORY_PROMPT, _scratch(df.sparkSession, "categories")).select("initial_id", "kind", "product_category")


@query("report_counts", ORD, """WITH g AS (SELECT segment, count(*) AS rows, count(*) FILTER (trim(status) <> '') AS filled FROM f GROUP BY segment)
    SELECT CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(filled) AS BIGINT) AS filled, count(segment) AS groups, round(sum(rows) FILTER (segment IS NOT NULL) / count(segment), 6) AS rows_per_group FROM g""")  # fmt: skip
def report_counts(df: DataFrame) -> DataFrame:
    return clean.report_counts(df, "status", "segment").withColumn("rows_per_group", F.round("rows_per_group", 6))


@query("label_encoding", ORD, "SELECT initial_id, CASE WHEN priority IS NOT NULL THEN dense_rank() OVER (ORDER BY priority) - 1 END AS priority FROM (SELECT * FROM f WHERE priority IS NOT NULL) UNION ALL SELECT initial_id, NULL FROM f WHERE priority IS NULL")
def label_encoding(df: DataFrame) -> DataFrame:
    return clean.label_encoded(df.select("initial_id", "priority"), "priority")


@query("shown_values", ORD, """SELECT initial_id, printf('%.4f', price) AS fixed_digits, printf('%.2f', initial_id / 7.0 / 100 * 100) || '%' AS percentage, format('{:,}', initial_id) AS thousands,
    substr(md5(coalesce(status, '') || chr(31) || nation), 1, 8) AS hash FROM f""")  # fmt: skip
def shown_values(df: DataFrame) -> DataFrame:
    share = F.col("initial_id") / F.lit(7.0) / 100
    return df.select("initial_id", shown(F.col("price")).alias("fixed_digits"), shown_percent(share).alias("percentage"), shown_thousands(F.col("initial_id")).alias("thousands"), short_hash(F.col("status"), F.col("nation")).alias("hash"))


@query("json_rows", ORD, """SELECT initial_id, '{"status":' || coalesce('"' || status || '"', 'null') || ',"nation":"' || nation || '"}' AS line FROM f""")
def json_rows(df: DataFrame) -> DataFrame:
    return df.select("initial_id", json_row(df.select("status", "nation")).alias("line"))


@query("prompt_rows", _DOCS, """SELECT initial_id, '{"lang":"' || lang || '","source":"' || source || '","_row_id":' || initial_id || '}' AS line FROM f""")
def prompt_rows(df: DataFrame) -> DataFrame:
    return df.select("initial_id", batches.row_json(["lang", "source"]).alias("line"))


@query("llm_extract_stub", _DOCS, "SELECT *, source AS product_name, source AS manufacturer FROM f")
def llm_extract_stub(df: DataFrame) -> DataFrame:
    asked = batches.prompts(batches.by_group(df, "source"), ["source", "lang"])
    return batches.join_results(df, batches.extracted(batches.ask_all(asked)))


@query("resume_batches", _DOCS, f"{_batches_sql('source')} SELECT initial_id AS row_id, source AS product_name, source AS manufacturer, batch_id FROM placed")
def resume_batches(df: DataFrame) -> DataFrame:
    folder = _scratch(df.sparkSession, "replies")
    batches.extract_resumable(df, "source", ["source", "lang"], folder, most_batches=3)
    return batches.extract_resumable(df, "source", ["source", "lang"], folder)


_REPLIES = """SELECT id, kind, brand, CASE id % 5 WHEN 0 THEN 'Here you are: ' || open || pair || ', "c": "C"' || shut || ' done' WHEN 1 THEN open || pair || ', "b": "B" ,  '
    WHEN 2 THEN 'no reply for ' || brand WHEN 3 THEN open || pair ELSE open || '"' || kind || '": ' || open END AS reply
    FROM (SELECT p_partkey AS id, p_type AS kind, p_brand AS brand, '"' || p_type || '": "' || p_brand || '"' AS pair, chr(123) AS open, chr(125) AS shut FROM {part})"""


@query("json_mapping_parse", _REPLIES, """SELECT id, kind AS original, brand AS simplified FROM f WHERE id % 5 IN (0, 1, 3) UNION ALL SELECT id, 'c', 'C' FROM f WHERE id % 5 = 0
    UNION ALL SELECT id, 'b', 'B' FROM f WHERE id % 5 = 1 UNION ALL SELECT id, kind, '{}' FROM f WHERE id % 5 = 4""")  # fmt: skip
def json_mapping_parse(df: DataFrame) -> DataFrame:
    """Replies with text around, with a comma and braces missing at the end, without any object, and with an object inside."""
    return df.select("id", F.explode(json_mapping(F.col("reply"))).alias("original", "simplified"))


#: Malformed lines of suppliers: company forms, notes in brackets, unequal case, too many parts, too few, and no name.
_VENDOR_LINES = """SELECT s_suppkey AS id, CASE s_suppkey % 7
    WHEN 0 THEN 'Firm ' || n || ' Inc; F' || k || ', F1;' || ' alias ' || k WHEN 1 THEN 'firm ' || n || ';F' || k || ';x;F2; alias ' || k || ', a' WHEN 2 THEN 'FIRM ' || n || ' (branch ' || k || ')'
    WHEN 3 THEN 'Firm ' || n || ', Ltd.; F3' WHEN 4 THEN ' ; F9; lost ' || k WHEN 5 THEN 'Firm ' || n || ' Technologies GmbH; ;b, a' ELSE 'vendor;families;aliases' END AS value
    FROM (SELECT s_suppkey, CAST(s_suppkey % 23 AS STRING) AS n, CAST(s_suppkey AS STRING) AS k FROM {supplier})"""
_FORMS = "|".join(vendors.COMPANY_FORMS)
_VENDORS = f"""l AS (SELECT string_split(value, ';') AS p FROM f), v AS (SELECT trim(p[1]) AS vendor, trim(CASE WHEN len(p) > 2 THEN array_to_string(p[2:len(p) - 1], ';') WHEN len(p) = 2 THEN p[2] ELSE '' END) AS families, trim(CASE WHEN len(p) > 2 THEN p[-1] ELSE '' END) AS aliases FROM l),
    b AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(vendor, '\\(.*?\\)', ' ', 'g'), '(?i)[\\s,]+({_FORMS})\\b\\.?', ' ', 'g'), '\\s+', ' ', 'g')) AS vendor, families, aliases FROM v WHERE vendor <> ''),
    m AS (SELECT upper(vendor) AS k, min(vendor) AS vendor, list_distinct(flatten(list(regexp_split_to_array(families, '\\s*,\\s*')))) AS fs, list_distinct(flatten(list(regexp_split_to_array(aliases, '\\s*,\\s*')))) AS xs FROM b GROUP BY upper(vendor)),
    vendors AS (SELECT k, vendor, array_to_string(list_sort(list_filter(fs, lambda x: x <> '')), ', ') AS families, array_to_string(list_sort(list_filter(xs, lambda x: x <> '')), ', ') AS aliases FROM m)"""


@query("vendor_lines", _VENDOR_LINES, "SELECT value FROM f")
def vendor_lines(df: DataFrame) -> DataFrame:
    """Lines written as files with a header each, and read again: lines that equal the header stay."""
    folder = _scratch(df.sparkSession, "vendors")
    df.select(F.col("value").alias("vendor;families;aliases")).repartition(3).write.option("header", True).option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return readers.read_vendor_lines(df.sparkSession, folder)


@query("vendor_parse_merge", _VENDOR_LINES, f"WITH {_VENDORS} SELECT row_number() OVER (ORDER BY k) - 1 AS place, vendor, families, aliases FROM vendors")
def vendor_parse_merge(df: DataFrame) -> DataFrame:
    return _placed(vendors.merge(vendors.parse(df)), "vendor", "families", "aliases")


@query("vendor_batches", _VENDOR_LINES, f"WITH {_VENDORS}, s AS (SELECT upper(substr(vendor, 1, 1)) AS batch_id, vendor || ';' || families || ';' || aliases AS line FROM vendors) SELECT row_number() OVER (ORDER BY batch_id) - 1 AS place, batch_id, string_agg(line, chr(10) ORDER BY line) AS lines FROM s GROUP BY batch_id")
def vendor_batches(df: DataFrame) -> DataFrame:
    return _placed(vendors.batch_lines(vendors.merge(vendors.parse(df))), "batch_id", "lines")


class _VendorClient:
    """Merges lines by their vendor's name in capitals, and verifies a vendor by its length."""

    def ask(self, prompt: str) -> str:
        found: dict[str, list[str]] = {}
        for x in prompt.splitlines():
            if x.count(";") == 2 and not x.endswith("aliases."):
                name, families, _ = x.split(";")
                found.setdefault(name.upper(), []).append(families)
        return json.dumps({"vendors": [{"vendor": n, "families": " + ".join(sorted(f)), "aliases": str(len(f))} for n, f in found.items()]})

    def verify(self, row: dict) -> dict:
        if len(row["vendor"]) % 2:
            raise ConnectionError("no answer")
        return {"vendor": row["vendor"].lower(), "families": "verified"}


@query("vendors_by_model", _VENDOR_LINES, f"WITH {_VENDORS.partition(', m AS')[0]}, u AS (SELECT upper(vendor) AS vendor, string_agg(replace(families, ';', ' '), ' + ' ORDER BY replace(families, ';', ' ')) AS families, CAST(count(*) AS VARCHAR) AS aliases FROM b GROUP BY upper(vendor)) SELECT row_number() OVER (ORDER BY vendor) - 1 AS place, * FROM u")
def vendors_by_model(df: DataFrame) -> DataFrame:
    rows = vendors.parse(df)
    return _placed(vendors.merge_by_model(rows.withColumns({"vendor": vendors.base_name(F.col("vendor")), "families": F.replace("families", F.lit(";"), F.lit(" ")), "aliases": F.lit("")}), _VendorClient), "vendor", "families", "aliases")


@query("vendors_verified", _VENDOR_LINES, f"WITH {_VENDORS} SELECT CASE WHEN length(vendor) % 2 = 1 THEN vendor ELSE lower(vendor) END AS vendor, CASE WHEN length(vendor) % 2 = 1 THEN families ELSE 'verified' END AS families, aliases FROM vendors")
def vendors_verified(df: DataFrame) -> DataFrame:
    return vendors.verify(vendors.merge(vendors.parse(df)), _VendorClient)


@query("web_answers", _PART, """WITH q AS (SELECT kind, brand, 'maker of ' || kind || ' ' || brand AS query, count(*) AS parts FROM f GROUP BY ALL), w AS (SELECT *, unnest(string_split(query, ' ')[:3]) AS w, unnest([1, 2, 3]) AS rank FROM q)
    SELECT kind, brand, parts, query, CAST(rank AS INT) AS rank, 'https://example.org/' || lower(w) || '#' || rank AS id, 'https://example.org/' || lower(w) AS url, upper(w) AS title, '2024-01-0' || rank AS published_date, substr(w, 1, 1) AS author, w || ' in ' || query AS text, NULL AS error FROM w WHERE w IS NOT NULL""")  # fmt: skip
def web_answers(df: DataFrame) -> DataFrame:
    asked = df.groupBy("kind", "brand").agg(F.count("*").alias("parts")).withColumn("query", F.concat_ws(" ", F.lit("maker of"), "kind", "brand"))
    return batches.web_answers(asked, per_query=3)


# --- files -------------------------------------------------------------------


def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents, whose texts hold line breaks and quotes, as CSV and reads them again, many tasks a file."""
    folder = _scratch(spark, "csv")
    rows = frame(spark, sf_dir, "SELECT doc_id AS initial_id, source, '\"' || source || '\",\n' || text AS text FROM {documents}")
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return readers.read_csv(spark, folder).select("initial_id", "source", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("hash"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes nations as Latin-1 CSV and reads them again, with the encoding detected."""
    folder = _scratch(spark, "csv")
    sinks.write_csv(frame(spark, sf_dir, _NATION).withColumn("name", F.concat("name", F.lit(" é"))), folder, "latin-1", with_id=True)
    return readers.read_csv(spark, folder)


def txt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _scratch(spark, "lines")
    frame(spark, sf_dir, "SELECT '  ' || r_name AS value FROM {region} UNION ALL SELECT '   '").write.text(folder)
    return readers.read_lines(spark, folder, "region")


def semicolon_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes nations as a file with ``;`` between quoted values and reads them again."""
    folder = _scratch(spark, "semicolon")
    sinks.write_semicolon(frame(spark, sf_dir, _NATION).select("name", F.concat("region", F.lit("; x")).alias("region")), folder)
    return readers.read_semicolon(spark, folder)


QUERIES |= {"csv_documents": csv_documents, "semicolon_roundtrip": semicolon_roundtrip, "csv_roundtrip": csv_roundtrip, "txt_lines": txt_lines}
ORACLES |= {
    "csv_documents": "SELECT doc_id AS initial_id, source, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS hash FROM (SELECT *, '\"' || source || '\",' || chr(10) || text AS t FROM documents)",
    "semicolon_roundtrip": f"SELECT name, region || '; x' AS region FROM ({plain(_NATION)})",
    "csv_roundtrip": f"SELECT initial_id, key, name || ' é' AS name, region_key, region FROM ({plain(_NATION)})",
    "txt_lines": "SELECT r_name AS region FROM region",
}
