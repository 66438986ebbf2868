"""Language identification by Bayesian fusion of evidence.

Text likelihoods (hashed byte trigrams, tempered since neighbouring trigrams
depend on each other) are combined with the declared markup language, the
address suffix, and a prior for the host that is smoothed towards its domain and
then towards the whole table. The last three come from grouped counts of the
texts' likeliest languages over all rows. Only the trigram table is fitted on a
sample: of each labelled language all rows, or about ``SAMPLE`` of them, chosen by
a hash of the key (rows that repeat a key go together). Languages whose rows hold
no trigram can't be learned, and are named in a warning, as are those of fewer than
``FEW`` rows.

``und`` stands for no known language: its likelihood is that of trigrams which
no language explains. Texts are read whole. Null and empty texts have no text
evidence; they are judged by their host, suffix and declaration, and are ``und``
if these are null too. Null hosts, suffixes and declarations are no evidence.
On ties the first language in alphabetical order wins, ``und`` last. Repeated
rows are judged one by one; an empty table gives no rows. Input columns named
``language``, ``posterior`` or ``kept`` are replaced unless ``carry`` leaves them out.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import _FOLD, LOWER, UPPER, bounded_batches, durable, freed, mix, pieces, release, small_or_not, string_bytes

BITS, SAMPLE, FEW = 16, 4000, 20
#: Log probability of a trigram under no language, the trigrams that count at most, and how many of them are worth one independent draw.
UNKNOWN, MOST, TEMPER = -12.0, 600, 4.0
#: A language with little text gives unseen trigrams this log probability, below ``UNKNOWN``, so that it does not draw what no language explains.
UNSEEN = -14.0
#: Bytes of texts whose trigrams are in memory at once, some 50 bytes each.
PIECE = 1 << 18
#: Pseudo-counts of the host's prior towards the domain's, and of the domain's towards the whole.
STRENGTH = 5.0
UND = "und"


def _trigrams(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram, and the text that each belongs to."""
    b = _FOLD[text]
    b = np.where((b >= 9) & (b <= 13), 32, b).astype(np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = owner[:-2] == owner[2:]
    ids = mix(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) & np.uint64((1 << BITS) - 1)
    return ids[inner].astype(np.int64), owner[:-2][inner]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log probabilities, buckets x languages

    def likelihoods(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tempered log likelihoods, texts x (languages, und)."""
        n = len(offsets) - 1
        ids, owner = _trigrams(text, offsets)
        count = np.bincount(owner, minlength=n)
        total = np.stack([np.bincount(owner, self.table[ids, k], minlength=n) for k in range(len(self.languages))], 1) if self.languages else np.zeros((n, 0))
        mean = np.concatenate([total / np.maximum(count, 1)[:, None], np.full((n, 1), UNKNOWN)], 1)
        return mean * (np.minimum(count, MOST) / TEMPER)[:, None]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("_tw_text"), F.shiftrightunsigned(F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), 1).alias("_tw_hash"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("_tw_hash").alias("first")).collect()  # a row per language
    upto = {r.lang: (1 << 63) - 1 if r.n <= sample else max(r.first, int(1.2 * sample / r.n * 2.0**62) << 1) for r in sizes}
    upto = {x: min(h, (1 << 63) - 1) for x, h in upto.items()}

    def below(limits: dict[str, int]) -> DataFrame:
        limit = F.broadcast(spark.createDataFrame(sorted(limits.items()), "lang string, _tw_upto long"))
        return labelled.join(limit, "lang").filter(F.col("_tw_hash") <= F.col("_tw_upto"))

    large = {r.lang: upto[r.lang] for r in sizes if r.n > sample}
    if large:
        by_hash = below(large).groupBy("lang", "_tw_hash").agg(F.count("*").alias("n"))  # about 1.2 x sample rows a language
        so_far = by_hash.select("lang", "_tw_hash", F.sum("n").over(Window.partitionBy("lang").orderBy("_tw_hash")).alias("rows"))
        upto |= {r.lang: r.upto for r in so_far.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("rows") <= sample, F.col("_tw_hash"))), F.min("_tw_hash")).alias("upto")).collect()}
    rows = below(upto).select("lang", "_tw_text")

    def run(batches):
        kept: dict[str, np.ndarray] = {}

        def rows():
            for x, got in kept.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(got[at])], names=["lang", "bucket", "n"])
            kept.clear()

        for b in batches:
            langs, (data, offsets) = np.array(b.column(0).to_pylist()), string_bytes(b.column(1))
            for i, j in pieces(offsets, PIECE):
                ids, owner = _trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                of_text = langs[i:j]
                for x in np.unique(of_text).tolist():
                    kept[x] = kept.get(x, 0) + np.bincount(ids[of_text[owner] == x], minlength=1 << BITS)
            if len(kept) > 64:
                yield from rows()
        yield from rows()

    counts = rows.mapInArrow(freed(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if poor := sorted(r.lang for r in sizes if r.n < FEW or r.lang not in languages):
        warnings.warn(f"languages with fewer than {FEW} labelled rows or without text, which are learned poorly or not at all: {', '.join(poor)}", stacklevel=2)
    table = np.zeros((1 << BITS, len(languages)))
    for k, x in enumerate(languages):
        mine = counts[counts["lang"] == x]
        table[mine["bucket"].to_numpy(), k] = mine["n"].to_numpy()
    least = math.exp(UNSEEN)
    table += np.minimum(0.1, table.sum(0) * least / (1 - least * (1 << BITS)))
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def with_likelihoods(df: DataFrame, model: Model, text: Column, name: str = "_tw_ll") -> DataFrame:
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            data, offsets = string_bytes(column)
            rows = [shared.value.likelihoods(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets, PIECE)]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(shared.value.languages) + 1))
            yield pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.ravel())
        release()

    return df.withColumn(name, score(text.cast("string")))


def _best(scores: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _sizes(n: int, label: Column) -> list[Column]:
    return [F.count(F.when(label == k, 1)).cast("double").alias(f"n{k}") for k in range(n)]


def _array(n: int) -> Column:
    return F.array(*(F.col(f"n{k}") for k in range(n)))


def domain_of(host: Column) -> Column:
    """The last two labels of a host, a stand-in for the registered domain."""
    return F.substring_index(host, ".", -2)


@dataclass
class Priors:
    overall: list[float]
    host: DataFrame
    suffix: DataFrame
    declared: DataFrame


def priors(slim: DataFrame, n: int) -> Priors:
    """From rows (_tw_ll, _tw_host, _tw_suffix, _tw_declared) of the whole table; classes are numbered below ``n``."""
    rows = slim.select("_tw_host", "_tw_suffix", "_tw_declared", _best(F.col("_tw_ll")).alias("_tw_label"))
    total = rows.agg(*_sizes(n, F.col("_tw_label"))).first()
    all_rows = sum(total)
    overall = [(x + 1) / (all_rows + n) for x in total]
    smooth = F.array(*map(F.lit, overall))
    host = durable(rows.filter("_tw_host IS NOT NULL").groupBy("_tw_host").agg(*_sizes(n, F.col("_tw_label"))).select("_tw_host", domain_of(F.col("_tw_host")).alias("_tw_domain"), _array(n).alias("_tw_own")))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    towards = lambda own, base: F.zip_with(own, base, lambda x, p: (x + STRENGTH * p) / (size(own) + STRENGTH))
    domain = host.groupBy("_tw_domain").agg(*(F.sum(F.get("_tw_own", F.lit(k))).alias(f"n{k}") for k in range(n))).select("_tw_domain", towards(_array(n), smooth).alias("_tw_base"))
    by_host = durable(host.join(small_or_not(domain), "_tw_domain").select("_tw_host", F.transform(towards(F.col("_tw_own"), F.col("_tw_base")), lambda x: F.log(x)).alias("_tw_prior")))

    def evidence(column: str, name: str) -> DataFrame:
        """log P(value | language) with one pseudo-count, for each value of the column."""
        counts = durable(rows.filter(F.col(column).isNotNull()).groupBy(column).agg(*_sizes(n, F.col("_tw_label"))).select(column, _array(n).alias("_tw_own")))
        sums = counts.agg(F.count("*"), *(F.coalesce(F.sum(F.get("_tw_own", F.lit(k))), F.lit(0.0)) for k in range(n))).first()
        return counts.select(column, F.zip_with("_tw_own", F.array(*(F.lit(float(x) + sums[0] + 1) for x in sums[1:])), lambda x, t: F.log((x + 1) / t)).alias(name))

    return Priors([math.log(x) for x in overall], by_host, evidence("_tw_suffix", "_tw_by_suffix"), evidence("_tw_declared", "_tw_by_declared"))


def fuse(df: DataFrame, model: Model, p: Priors, least: float = 0.5) -> DataFrame:
    """Adds language, posterior and kept; drops the working columns."""
    names = F.array(*map(F.lit, [*model.languages, UND]))
    none = F.array(*(F.lit(0.0) for _ in p.overall))
    out = df.join(small_or_not(p.host), "_tw_host", "left").join(small_or_not(p.suffix), "_tw_suffix", "left").join(small_or_not(p.declared), "_tw_declared", "left")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    scores = add(add(F.col("_tw_ll"), F.coalesce("_tw_prior", F.array(*map(F.lit, p.overall)))), add(F.coalesce("_tw_by_suffix", none), F.coalesce("_tw_by_declared", none)))
    out = out.withColumn("_tw_scores", scores)
    top = F.array_max("_tw_scores")
    spoken = F.exists("_tw_ll", lambda x: x != 0) | F.col("_tw_prior").isNotNull() | F.col("_tw_by_suffix").isNotNull() | F.col("_tw_by_declared").isNotNull()
    out = out.withColumn("language", F.when(spoken, F.get(names, _best(F.col("_tw_scores")))).otherwise(UND))
    out = out.withColumn("posterior", 1 / F.aggregate(F.transform("_tw_scores", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b))
    out = out.withColumn("kept", (F.col("language") != UND) & (F.col("posterior") >= least))
    return out.drop(*(c for c in out.columns if c.startswith("_tw_")))


def identify(df: DataFrame, model: Model, text: Column, host: Column | None = None, suffix: Column | None = None, declared: Column | None = None, carry: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """``carry`` (all columns if None) with language, posterior and kept (a known language of posterior ``least`` or more).

    Two passes: the first counts, over all rows, what the priors need; the second
    judges. The texts are not shuffled.
    """
    null = F.lit(None).cast("string")
    keys = {"_tw_host": host, "_tw_suffix": suffix, "_tw_declared": declared}
    named = df.select(*(df.columns if carry is None else carry), text.alias("_tw_text"), *((null if c is None else c.cast("string")).alias(k) for k, c in keys.items()))
    named = named.drop(*({"language", "posterior", "kept"} & set(named.columns)))
    scored = with_likelihoods(named, model, F.col("_tw_text")).drop("_tw_text")
    slim = durable(scored if carry is not None else scored.select("_tw_ll", *keys))
    p = priors(slim, len(model.languages) + 1)
    return fuse(slim if carry is not None else scored, model, p, least)


# --- evidence of web pages ---------------------------------------------------


def page_text(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def page_declared(html: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def url_host(url: Column) -> Column:
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#:]*)", 1), UPPER, LOWER)
    return F.when(host != "", host)


def url_suffix(url: Column) -> Column:
    return F.substring_index(url_host(url), ".", -1)
