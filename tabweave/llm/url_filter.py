"""URL filters: rules first, then naive Bayes over segmented host names and path tokens.

Concatenated names in hosts are split into words by a unigram Viterbi search
over word counts of the pages' titles. Multinomial naive Bayes learns token
counts of the addresses that a rule decides, by grouped aggregation over all of
them, and judges the others. Nothing is left out of either table: the workers
read the ``HEAD`` tokens and the ``WORDS`` words that are used most, and the
others are joined by a shuffle.

Null addresses and ones without ``://`` have empty host and path, no rule, and
the method's verdict on no tokens (the prior; ``allow`` on a tie). Rows that
repeat are judged one by one. Words of titles have any length; only lengths that occur among them are searched. Addresses of any length are read
whole. Columns of the input other than keys, url and html are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tabweave.llm.common import LOWER, UPPER, bounded_batches, durable, freed

HEAD, WORDS = 50_000, 200_000
#: A host with more than one in so many of the rows does not go through a shuffle by host.
HOT = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Unigram Viterbi: the most probable split of a name into words."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: the count of all words, if ``counts`` has only some."""
        self.total = total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.lengths = {len(w) for w in counts}
        self.unknown = math.log(total) + 3.0
        self.memo: dict[str, list[str]] = {}

    @classmethod
    def of(cls, cost: dict[str, float], total: int) -> Segmenter:
        """From another one's costs and total."""
        out = cls({}, total - 1)
        out.cost, out.lengths = cost, {len(w) for w in cost}
        return out

    def split(self, name: str, more: dict[str, int] | None = None) -> list[str]:
        """``more``: counts of rarer words in this name."""
        if more:
            return self._split(name, ChainMap({w: -math.log(n / self.total) for w, n in more.items()}, self.cost), self.lengths | {len(w) for w in more})
        if name not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[name] = self._split(name, self.cost, self.lengths)
        return self.memo[name]

    def _split(self, name: str, costs: dict[str, float], lengths: set[int]) -> list[str]:
        best, back = [0.0], [0]
        lengths = sorted({1, *lengths}, reverse=True)
        for j in range(1, len(name) + 1):
            options = []
            for i in (j - n for n in lengths if n <= j):
                cost = costs.get(name[i:j])
                if cost is None and j - i > 1:
                    continue
                options.append((best[i] + (self.unknown if cost is None else cost), i))
            cost, i = min(options)
            best.append(cost)
            back.append(i)
        words, j = [], len(name)
        while j:
            words.append(name[back[j] : j])
            j = back[j]
        return words[::-1]


def _name_parts(host: str) -> Iterator[str]:
    """Runs of letters and of digits in all labels but the last."""
    for label in [x for x in host.split(".") if x][:-1]:
        yield from re.findall(r"[a-z]+|\d+", label)


def tokens(host: str, path: str, segmenter: Segmenter, more: dict[str, int] | None = None) -> list[str]:
    labels = [x for x in host.split(".") if x]
    out = [f"suffix:{labels[-1]}"] if labels else []
    for part in _name_parts(host):
        out += ["host:#"] if part.isdigit() else [f"host:{w}" for w in segmenter.split(part, more)]
    for part in re.findall(r"[^\W\d_]+|\d+", path.lower()):
        out.append(f"path:#{part[0]}" if part.isdigit() else f"path:{part}")
    return out


def title_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, n: counts of the words of all titles."""
    title = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1))
    return pages.select(F.explode(F.regexp_extract_all(title, F.lit("([a-z]+)"), 1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _substrings(host: str, lengths: list[int]) -> set[str]:
    """What may be a word of the host, of the lengths that words have."""
    return {x[i : i + n] for x in _name_parts(host) if not x.isdigit() for n in lengths for i in range(len(x) - n + 1)}


def _with_words(ruled: DataFrame, counts: DataFrame) -> tuple[DataFrame, Segmenter]:
    """``ruled`` with ``_tw_more``, the counts of its host's words outside the segmenter, and the segmenter.

    Only words that occur in some host matter. The segmenter has the ``WORDS``
    of them that occur in most hosts.
    """
    spark = ruled.sparkSession
    hosts = ruled.groupBy("host").agg(F.count("*").alias("rows"))
    lengths = sorted(r.n for r in counts.select(F.length("word").alias("n")).distinct().collect())  # few: no word is longer than its title

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        uses = Counter()
        for b in batches:
            for h in b.column(0).to_pylist():
                uses.update(_substrings(h, lengths))
                if len(uses) > 200_000:
                    yield pa.RecordBatch.from_pydict({"word": list(uses), "uses": list(uses.values())})
                    uses.clear()
        if uses:
            yield pa.RecordBatch.from_pydict({"word": list(uses), "uses": list(uses.values())})

    total = counts.agg(F.sum("n")).first()[0] or 0
    uses = hosts.select("host").mapInArrow(freed(found), "word string, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))
    used = durable(counts.join(uses, "word"))
    head = {r.word: r.n for r in used.orderBy(F.desc("uses"), "word").limit(WORDS).collect()}
    segmenter = Segmenter(head, total)
    if used.count() == len(head):
        return ruled.withColumn("_tw_more", F.lit(None).cast("map<string,bigint>")), segmenter
    known = spark.sparkContext.broadcast(frozenset(head))

    def rare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for h in b.column(0).to_pylist():
                if words := sorted(_substrings(h, lengths) - known.value):
                    yield pa.RecordBatch.from_pydict({"host": [h] * len(words), "word": words})

    by_host = hosts.select("host").mapInArrow(freed(rare), "host string, word string").join(used.select("word", "n"), "word")
    by_host = durable(by_host.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("_tw_more")))
    hot = F.broadcast(hosts.filter(F.col("rows") > ruled.count() // HOT).select("host", F.lit(True).alias("_tw_hot")))  # fewer than HOT rows
    rows = ruled.join(hot, "host", "left").withColumn("_tw_at", F.monotonically_increasing_id() % 1024)
    # the rows of a hot host get theirs by a broadcast, and are dealt evenly in the shuffle, where they find nothing
    frequent = F.broadcast(by_host.join(hot, "host").select(F.col("host").alias("_tw_host"), F.col("_tw_more").alias("_tw_frequent")))
    rows = rows.join(frequent, F.col("host") == F.col("_tw_host"), "left").withColumn("_tw_key", F.when(F.col("_tw_hot"), F.concat(F.lit("\n"), F.col("_tw_at"))).otherwise(F.col("host")))
    rows = rows.join(by_host.withColumnRenamed("host", "_tw_key"), "_tw_key", "left")
    return rows.select(*(F.col(c) for c in ruled.columns), F.coalesce("_tw_frequent", "_tw_more").alias("_tw_more")), segmenter


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keys``, host, path, rule, verdict, and block_odds, the method's log odds of blocking."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    ruled = pages.select(*keys, host.alias("host"), path.alias("path")).withColumns(dict(zip(("rule", "_tw_verdict"), longest_rule(F.col("host"), F.col("path"), rules), strict=True)))
    ruled, segmenter = _with_words(ruled, title_words(pages, html))
    words = spark.sparkContext.broadcast((dict(segmenter.cost), segmenter.total))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        segmenter, found = Segmenter.of(*words.value), Counter()
        for b in batches:
            for h, p, v, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found[v, ""] += 1
                found.update((v, t) for t in tokens(h, p, segmenter, dict(m or ())))
            if len(found) > 200_000:
                yield pa.RecordBatch.from_pydict({"verdict": [k[0] for k in found], "token": [k[1] for k in found], "n": list(found.values())})
                found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"verdict": [k[0] for k in found], "token": [k[1] for k in found], "n": list(found.values())})

    # all pages are counted, for the tokens that are used most; only those with a verdict are evidence
    seen = ruled.select("host", "path", "_tw_verdict", "_tw_more").mapInArrow(freed(count), "verdict string, token string, n long")
    by_token = durable(seen.groupBy("token").agg(*(F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("allow", "block")), F.sum("n").alias("n")))
    totals = by_token.agg(*(F.sum(F.when(F.col("token") == "", F.col(v))).alias(f"docs_{v}") for v in ("allow", "block")), *(F.sum(F.when(F.col("token") != "", F.col(v))).alias(v) for v in ("allow", "block")), F.count_if(F.col("allow") + F.col("block") > 0).alias("kinds"), F.count_if(F.col("token") != "").alias("all_kinds")).first()
    a_docs, b_docs = totals.docs_allow or 0, totals.docs_block or 0
    a_all, b_all = ((totals[v] or 0) + totals.kinds + 1 for v in ("allow", "block"))
    prior = math.log((b_docs + 1) / (a_docs + 1))
    by_token = by_token.filter("token <> ''")
    head = by_token.orderBy(F.desc("n"), "token").limit(HEAD).collect()
    odds = spark.sparkContext.broadcast({r.token: math.log((r.block + 1) / b_all) - math.log((r.allow + 1) / a_all) for r in head})

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        segmenter, table = Segmenter.of(*words.value), odds.value
        for b in batches:
            hosts, paths, more = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("host", "path", "_tw_more"))
            out, rare = [], []
            for h, p, m in zip(hosts, paths, more, strict=True):
                all_tokens = tokens(h, p, segmenter, dict(m or ()))
                out.append(prior + sum(table[t] for t in all_tokens if t in table))
                rare.append([t for t in all_tokens if t not in table])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64()), pa.array(rare, pa.list_(pa.string()))], names=[*b.schema.names[:-1], "block_odds", "_tw_rare"])

    kept = StructType([f for f in ruled.schema if f.name != "_tw_more"]).add("block_odds", "double").add("_tw_rare", ArrayType(StringType()))
    judged = ruled.mapInArrow(freed(score), kept)
    if totals.all_kinds > len(head):
        judged = durable(judged.withColumn("_tw_row", F.monotonically_increasing_id()))
        rare = judged.select("_tw_row", F.explode("_tw_rare").alias("token")).groupBy("_tw_row", "token").agg(F.count("*").alias("times"))
        each = F.col("times") * (F.log((F.col("block") + 1) / b_all) - F.log((F.col("allow") + 1) / a_all))
        # sorted, so that a page's sum does not depend on the order of the shuffle
        by_row = rare.join(by_token, "token").groupBy("_tw_row").agg(F.aggregate(F.array_sort(F.collect_list(each)), F.lit(0.0), lambda x, y: x + y).alias("_tw_odds"))
        judged = judged.join(by_row, "_tw_row", "left").withColumn("block_odds", F.col("block_odds") + F.coalesce("_tw_odds", F.lit(0.0)))
    return judged.select(*keys, "host", "path", "rule", F.coalesce("_tw_verdict", F.when(F.col("block_odds") > 0, "block").otherwise("allow")).alias("verdict"), "block_odds")
