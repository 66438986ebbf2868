"""Frequent itemsets and association rules over rows of ``column=value`` items."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tabweave.functions.names import col
from tabweave.functions.text import as_text, significant
from tabweave.operators.pairs import ROW_ID
from tabweave.storage import materialised, numbered, quantiles, small_or_not

#: Candidate sets (and frequent items) that are broadcast together, and distinct baskets a task mines by itself.
SETS, BASKETS = 200_000, 100_000


def edges(df: DataFrame, column: str, bins: int = 5, method: str = "quantile") -> list[float]:
    """Bin edges of a numeric column, without repeats; quantiles are exact and interpolated."""
    c = col(column).cast("double")
    if method == "quantile":
        return sorted(set(quantiles(df, c, [i / bins for i in range(bins + 1)])))
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None:
        return []
    if low == high:
        step = 0.001 * abs(low) or 0.001
        return [low - step, *(low - step + 2 * step * i / bins for i in range(1, bins)), high + step]
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def labels(cuts: Sequence[float], method: str = "quantile") -> list[str]:
    """``(lo, hi]`` with three significant digits; the first edge is lowered so that it is included."""
    shown = [significant(x) for x in cuts]
    if shown:
        shown[0] = significant(shown[0] - 0.001 if method == "quantile" else shown[0] - (cuts[-1] - cuts[0]) * 0.001)
    return [f"({a}, {b}]" for a, b in zip(shown[:-1], shown[1:], strict=True)]


def bin_label(c: Column, cuts: Sequence[float], method: str = "quantile") -> Column:
    """The label of the value's bin; null outside, and for fewer than two edges."""
    c, out = c.cast("double"), F.lit(None).cast("string")
    for high, name in reversed(list(zip(cuts[1:], labels(cuts, method), strict=True))):
        out = F.when(c <= high, name).otherwise(out)
    return F.when(c >= cuts[0], out) if cuts else out


def binned(df: DataFrame, column: str, bins: int = 5, method: str = "quantile") -> DataFrame:
    return df.withColumn(column, bin_label(col(column), edges(df, column, bins, method), method))


def transactions(df: DataFrame, columns: Sequence[str], treat_na: bool = True, bins: int = 5) -> DataFrame:
    """initial_id, items: the distinct items of each row; rows without any are left out."""
    for c in columns:
        if isinstance(df.schema[c].dataType, NumericType | BooleanType):
            df = binned(df.withColumn(c, col(c).cast("double")), c, bins)
    item = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(as_text(col(c), df.schema[c].dataType), F.lit("NA") if treat_na else F.lit(None)))
    items = F.array_sort(F.array_distinct(F.filter(F.array(*(item(c) for c in columns)), lambda x: x.isNotNull())))
    return df.select(ROW_ID, items.alias("items")).filter(F.size("items") > 0)


class PrefixTree:
    """Weighted sorted baskets by common prefixes: node -> (item, weight, children)."""

    def __init__(self, baskets: Iterable[tuple[Sequence[int], int]]):
        self.children: list[dict[int, int]] = [{}]
        self.item, self.weight, self.parent = [-1], [0], [-1]
        self.at: dict[int, list[int]] = {}
        for items, w in baskets:
            node = 0
            for i in items:
                child = self.children[node].get(i)
                if child is None:
                    child = len(self.item)
                    self.children[node][i] = child
                    self.children.append({})
                    self.item.append(i)
                    self.weight.append(0)
                    self.parent.append(node)
                    self.at.setdefault(i, []).append(child)
                self.weight[child] += w
                node = child

    def before(self, item: int) -> list[tuple[list[int], int]]:
        """The conditional baskets of an item: what precedes it on each of its paths."""
        out = []
        for node in self.at[item]:
            path, up = [], self.parent[node]
            while up > 0:
                path.append(self.item[up])
                up = self.parent[up]
            out.append((path[::-1], self.weight[node]))
        return out

    def mine(self, least: float, most: int | None) -> Iterator[tuple[int, ...]]:
        """Sets of at least that weight and at most that size, items ascending."""
        for item, nodes in self.at.items():
            if sum(self.weight[n] for n in nodes) >= least:
                yield (item,)
                if most is None or most > 1:
                    for rest in PrefixTree(self.before(item)).mine(least, None if most is None else most - 1):
                        yield (*rest, item)


def held_sets(tree: dict, basket: Sequence[int]) -> Iterator[int]:
    """Numbers of the sets of a nested dict (item -> rest, None -> number) that a sorted basket holds."""
    for k, i in enumerate(basket):
        rest = tree.get(i)
        if rest is not None:
            if None in rest:
                yield rest[None]
            yield from held_sets(rest, basket[k + 1 :])


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.1, max_size: int | None = 5) -> DataFrame:
    """items (sorted), size, freq, support of all sizes from two passes, whatever the largest size.

    Identical baskets are counted once with their multiplicity and dealt evenly over tasks. A set that is frequent in the table is
    frequent, by the same share, in some task's baskets: so each task mines its own by conditional prefix trees, and the
    union of what they find holds every frequent set. The second pass counts these exactly, in blocks of ``SETS`` that are
    broadcast. No basket, item or prefix is a shuffle's key, so that frequent items make no task larger than others.
    """
    spark = baskets.sparkSession
    weighted = materialised(baskets.groupBy("items").agg(F.count("*").alias("w")))
    total = weighted.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    least = max(1, math.ceil(min_support * total - 1e-9))
    empty = spark.createDataFrame([], "items array<string>, size int, freq long, support double")
    if not total:
        return empty
    singles = weighted.select(F.explode("items").alias("i"), "w").groupBy("i").agg(F.sum("w").alias("freq")).filter(F.col("freq") >= least)
    names = [r.i for r in singles.select("i").orderBy("i").limit(SETS + 1).collect()]
    if len(names) > SETS:
        raise ValueError(f"more than {SETS} items are frequent; raise min_support")
    code = spark.sparkContext.broadcast({n: k for k, n in enumerate(names)})
    # bounded slices; of small tables no more than leave enough rows to tell frequent sets from chance
    slices = max(1, -(-weighted.count() // BASKETS), min(spark.sparkContext.defaultParallelism, least // 50))
    dealt = materialised(weighted.repartition(slices, F.xxhash64("items")))

    def coded(batches: Iterator) -> Iterator[tuple[list[int], int]]:
        known = code.value
        for b in batches:
            for items, w in zip(b["items"], b["w"], strict=True):
                yield sorted(known[i] for i in items if i in known), int(w)

    def local(batches: Iterator) -> Iterator:
        import pandas as pd

        mine = list(coded(batches))  # one of the even slices
        share = least / total * sum(w for _, w in mine)
        found = [list(s) for s in PrefixTree(mine).mine(max(share - 1e-9, 1e-9), max_size)]
        yield pd.DataFrame({"set": found})

    candidates = materialised(numbered(dealt.mapInPandas(local, "set array<int>").distinct(), "k"))
    many, found = candidates.count(), None
    for start in range(0, many, SETS):
        block = candidates.filter(F.col("k").between(start, start + SETS - 1)).select("k", "set").collect()  # at most SETS rows
        tree: dict = {}
        for r in block:
            node = tree
            for i in r.set:
                node = node.setdefault(i, {})
            node[None] = r.k
        shared = spark.sparkContext.broadcast(tree)

        def count(batches: Iterator, shared=shared) -> Iterator:
            import pandas as pd

            sums: Counter = Counter()
            for items, w in coded(batches):
                for k in held_sets(shared.value, items):
                    sums[k] += w
            yield pd.DataFrame({"k": list(sums), "w": list(sums.values())}).astype("int64")

        part = dealt.mapInPandas(count, "k long, w long").groupBy("k").agg(F.sum("w").alias("freq")).filter(F.col("freq") >= least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    shown = spark.createDataFrame([(names,)], "names array<string>")
    items = F.array_sort(F.transform("set", lambda i: F.get("names", i)))
    return candidates.join(small_or_not(materialised(found)), "k").crossJoin(F.broadcast(shown)).select(items.alias("items"), F.size("set").alias("size"), "freq", (F.col("freq") / total).alias("support"))  # one row of names


def sort_itemsets(itemsets: DataFrame) -> DataFrame:
    """By size, then by support with the highest first; ties by items."""
    return itemsets.orderBy("size", F.desc("support"), "items")


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """antecedent, consequent, support, confidence, lift for every split of every itemset."""
    sizes = [r[0] for r in itemsets.select("size").distinct().collect()]
    whole = itemsets.filter("size > 1")
    splits = None
    for n in sorted(s for s in sizes if s > 1):
        masks = [list(c) for k in range(1, n) for c in combinations(range(n), k)]
        sets = F.array(*(F.array(*(F.col("items")[i] for i in m)) for m in masks))
        part = whole.filter(F.col("size") == n).select("items", "support", F.explode(sets).alias("antecedent"))
        splits = part if splits is None else splits.unionByName(part)
    if splits is None:
        return itemsets.limit(0).select(F.col("items").alias("antecedent"), F.col("items").alias("consequent"), "support", F.col("support").alias("confidence"), F.col("support").alias("lift"))
    splits = splits.withColumn("consequent", F.array_except("items", "antecedent"))
    known = itemsets.select("items", "support")
    out = splits.join(known.toDF("antecedent", "sa"), "antecedent").join(known.toDF("consequent", "sc"), "consequent")
    conf = F.col("support") / F.col("sa")
    lift = F.when(F.col("sc") > 0, conf / F.col("sc")).otherwise(F.lit(float("inf")))
    return out.select("antecedent", "consequent", "support", conf.alias("confidence"), lift.alias("lift")).filter(F.col("confidence") >= min_confidence)


def mine(df: DataFrame, columns: Sequence[str], min_support: float = 0.1, min_confidence: float = 0.5, max_size: int | None = 5, treat_na: bool = True, bins: int = 5) -> tuple[DataFrame, DataFrame | None] | None:
    """(itemsets, rules); no rules at a confidence of 0, None without any transaction."""
    baskets = transactions(df, columns, treat_na, bins)
    if baskets.isEmpty():
        return None
    sets = frequent_itemsets(baskets, min_support, max_size)
    return sets, association_rules(sets, min_confidence) if min_confidence > 0 else None


def filter_rules(rules: DataFrame, support=(0.0, 1.0), confidence=(0.0, 1.0), lift=(0.0, float("inf")), antecedent_size=(1, 99), consequent_size=(1, 99), search: str = "") -> DataFrame:
    """Inclusive ranges (an infinite lift passes any); ``search`` holds items, of which a rule must have one."""
    out = rules.filter(F.col("support").between(*support) & F.col("confidence").between(*confidence) & (F.col("lift").between(*lift) | (F.col("lift") == float("inf"))))
    out = out.filter(F.size("antecedent").between(*antecedent_size) & F.size("consequent").between(*consequent_size))
    terms = [t.strip().lower() for t in search.split(",") if t.strip()]
    if terms:
        have = F.transform(F.concat("antecedent", "consequent"), lambda x: F.lower(x))
        out = out.filter(F.arrays_overlap(have, F.array(*map(F.lit, terms))))
    return out


def sort_rules(rules: DataFrame, by: str = "confidence", descending: bool = True) -> DataFrame:
    keys = {"antecedent_size": F.size("antecedent"), "consequent_size": F.size("consequent"), "lift": F.when(F.col("lift") == float("inf"), 0.0).otherwise(F.col("lift"))}
    key = keys.get(by, col(by))
    return rules.orderBy(key.desc() if descending else key.asc(), "antecedent", "consequent")


def rule_statistics(rules: DataFrame) -> DataFrame:
    finite = F.when(F.col("lift") != float("inf"), F.col("lift"))
    return rules.agg(F.count("*").alias("rules"), *(f(c).alias(f"{n}_{k}") for n, c in (("confidence", F.col("confidence")), ("lift", finite)) for k, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))))


def rule_edges(rules: DataFrame, metric: str = "confidence") -> DataFrame:
    """source, target, weight, width, rule_type: items of antecedents and consequents; the type is the first rule's."""
    value = F.when(col(metric) == float("inf"), 0.0).otherwise(col(metric))
    kind = F.concat(F.size("antecedent"), F.lit("-to-"), F.size("consequent"))
    order = F.struct(-F.col("confidence"), "antecedent", "consequent")
    pairs = rules.select(F.explode("antecedent").alias("source"), "consequent", value.alias("v"), kind.alias("kind"), order.alias("o")).select("source", F.explode("consequent").alias("target"), "v", "kind", "o")
    out = pairs.groupBy("source", "target").agg(F.max("v").alias("weight"), F.min_by("kind", "o").alias("rule_type"))
    span = out.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    width = F.coalesce(F.try_divide(F.col("weight") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 3 + 0.5
    return out.crossJoin(F.broadcast(span)).select("source", "target", "weight", width.alias("width"), "rule_type")  # one row


def density(nodes: int, n_edges: int) -> float:
    return n_edges / (nodes * (nodes - 1)) if nodes > 1 else 0.0
