"""Vendor catalogues: lenient parsing, merging by base name, verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.names import col
from tabweave.functions.text import json_object
from tabweave.operators.batches import ask_all
from tabweave.storage import materialised

#: Company forms that don't belong to a vendor's base name.
COMPANY_FORMS = ("inc", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "gmbh", "ag", "sa", "plc", "technologies", "networks", "systems", "group")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """vendor, families, aliases of lines with ``;``: the first part, all between, and the last; quotes mean nothing.

    Two parts leave aliases empty, one part leaves both empty. Blank vendors are dropped.
    """
    p = F.split(col(column), ";", -1)
    n = F.size(p)
    families = F.when(n > 2, F.array_join(F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0))), ";")).when(n == 2, F.get(p, F.lit(1))).otherwise("")
    aliases = F.when(n > 2, F.element_at(p, -1)).otherwise("")
    return lines.select(F.trim(F.get(p, F.lit(0))).alias("vendor"), F.trim(families).alias("families"), F.trim(aliases).alias("aliases")).filter("vendor <> ''")


def base_name(vendor: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(vendor, r"\(.*?\)", " "), r"(?i)[\s,]+(" + "|".join(COMPANY_FORMS) + r")\b\.?", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _united(column: str) -> Column:
    parts = F.flatten(F.collect_set(F.split(col(column), r"\s*,\s*", -1)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ", ")


def merge(catalogue: DataFrame) -> DataFrame:
    """One row per base name, with the union of families and aliases, ordered without regard to case."""
    out = catalogue.withColumn("vendor", base_name(F.col("vendor"))).groupBy(F.upper("vendor").alias("_k")).agg(F.min("vendor").alias("vendor"), _united("families").alias("families"), _united("aliases").alias("aliases"))
    return out.orderBy("_k").drop("_k")


def batch_lines(catalogue: DataFrame) -> DataFrame:
    """batch_id (first letter) and its rows as ``;`` lines."""
    line = F.concat_ws(";", "vendor", "families", "aliases")
    return catalogue.groupBy(F.upper(F.substring("vendor", 1, 1)).alias("batch_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines")).orderBy("batch_id")


#: Instructions for one letter's vendors; ``[rows]`` is replaced.
PROMPT = """Merge entries of the same vendor among these lines of the form name;families;aliases.
Answer with one JSON object {"vendors": [{"vendor": text, "families": text, "aliases": text}]}.
[rows]"""


def merge_by_model(catalogue: DataFrame, factory: Callable, template: str = PROMPT, keep: bool = False) -> DataFrame:
    """vendor, families, aliases as a model merges them, one call per first letter, ordered without regard to case.

    A letter whose call fails, or whose reply can't be parsed, is lost, or stays as it was if ``keep`` is set.
    """
    asked = batch_lines(catalogue).select("batch_id", F.replace(F.lit(template), F.lit("[rows]"), F.col("lines")).alias("prompt"))
    replies = materialised(ask_all(asked, factory))
    read = replies.select("batch_id", F.from_json(json_object(F.col("reply")), "struct<vendors:array<struct<vendor:string,families:string,aliases:string>>>").vendors.alias("v"))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("families", "aliases")]
    out = read.select(F.inline("v")).filter(F.trim("vendor") != "").select("vendor", *texts)
    if keep:
        lost = read.filter("v IS NULL").select("batch_id")
        rest = catalogue.withColumn("batch_id", F.upper(F.substring("vendor", 1, 1))).join(lost, "batch_id").select("vendor", *texts)
        out = out.unionByName(rest)
    return out.orderBy(F.upper("vendor"), "vendor")


def verify(catalogue: DataFrame, factory: Callable) -> DataFrame:
    """Each row through ``client.verify(dict) -> dict``; a row whose call fails stays as it is."""

    def run(batches):
        import pandas as pd

        client = factory()
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                try:
                    rows.append({k: client.verify(r).get(k, v) for k, v in r.items()})
                except Exception:  # the policy is to keep the row
                    rows.append(r)
            yield pd.DataFrame(rows, columns=b.columns)

    return catalogue.mapInPandas(run, catalogue.schema)
