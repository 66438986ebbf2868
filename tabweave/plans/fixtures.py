"""Inputs with missing values and errors, derived from the sample tables by SQL that any engine runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CNR = """
SELECT c_custkey AS initial_id, n_name AS child,
       CASE WHEN c_custkey % 53 = 0 THEN 'REGION_X' WHEN c_custkey % 97 = 0 THEN NULL ELSE r_name END AS parent
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

ORD = """
SELECT o_orderkey AS initial_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price,
       n_name AS nation, CASE WHEN o_custkey % 53 = 0 THEN 'REGION_X' ELSE r_name END AS region
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

DIRTY = """
SELECT p_partkey AS initial_id,
       CASE WHEN p_partkey % 5 = 0 THEN '  ' || p_name WHEN p_partkey % 5 = 1 THEN p_name || ' ' WHEN p_partkey % 5 = 2 THEN '   ' ELSE p_name END AS name,
       CASE WHEN p_partkey % 100 = 0 THEN 'x' END AS sparse, CASE WHEN p_partkey % 101 = 0 THEN 'z' ELSE 'y' END AS const,
       CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END AS blank,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS a, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS b
FROM {part}"""

GROUPS = """
SELECT c_custkey AS initial_id, 'g' || CAST(c_custkey % 300 AS STRING) AS leaf, 'o' || CAST(c_custkey % 3 AS STRING) AS other,
       CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 300 < 10 AND c_custkey % 7 = 0 THEN 'b' ELSE 'b' || CAST(CAST(FLOOR((c_custkey % 300) / 10.0) AS INT) AS STRING) END AS branch
FROM {customer}"""

LINES = "SELECT l_orderkey * 10 + l_linenumber AS initial_id, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_linestatus AS line FROM {lineitem}"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)
