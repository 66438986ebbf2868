"""Document fingerprints by order MinHash, and their likeness to edited texts and to the following document.

A text's k-mers are its runs of ``k`` bytes of UTF-8 (the whole text if it is shorter), each
numbered by its earlier occurrences. Each of ``m`` hash functions selects the ``picks`` numbered
k-mers of least value; these are put back in the order of the text, and the hash of this tuple is one
component of the fingerprint. The share of equal components is the likeness of two texts. Since the
order of the selected k-mers counts, not only their set, it falls with the edit distance.

``followed`` pairs every document with the next one in descending order of the key. Keys are dealt into
ranges by cuts from a bounded sample; whole texts are shuffled once, and the first row of every range is also sent to
the range before, so that no task sees more than its range and no row lacks its successor.

Null texts are empty. Empty texts have one fingerprint, which no other text has but by a clash of 32-bit hashes. Rows
without key come last; rows that repeat a key follow each other in the order of a hash of their texts, and
rows that repeat both are interchangeable: keys that hold more rows than a range are sent once with
their number. The only row of a table is followed by itself. Texts are read whole, of any length. Other columns of the
input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import bounded_batches, durable, freed, mix, partitions, string_bytes

#: Bytes of a k-mer, hash functions, and k-mers that each selects.
K, FUNCTIONS, PICKS = 16, 64, 2
#: Ranges a shuffle partition, and keys of the sample that cuts them.
RANGES, SAMPLE = 4, 1 << 18
#: K-mers hashed side by side, and the number that a function's first limit should let through for each one it selects.
SIDE, ENOUGH = 4096, 8
_M1, _M2, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x632BE59BD9B4E019)


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each place of ``data``, as if zeros followed."""
    n = len(data)
    padded = np.zeros(-(-(n + k) // 8) * 8 + 16, np.uint8)
    padded[:n] = data
    words = np.empty(len(padded) - 8, np.uint64)  # the 8 bytes from each place
    for r in range(8):
        run = padded[r : r + (len(words) - r + 7) // 8 * 8].view(np.uint64)
        words[r::8] = run[: len(words[r::8])]
    if k < 8:
        return mix(words[:n] & np.uint64((1 << 8 * k) - 1))
    h = np.full(n, _SEED)
    for at in [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h = (h ^ words[at : at + n]) * _M1
        h ^= h >> np.uint64(32)
    return h * _M2


def numbered(h: np.ndarray) -> np.ndarray:
    """The hashes with each one's number of earlier equal ones mixed in."""
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return h
    values = np.unique(again)
    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
    places = np.flatnonzero(values[at] == h)
    order = np.argsort(at[places], kind="stable")
    group = at[places][order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    number = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    out = h.copy()
    later = places[order][number > 0]
    out[later] = mix(h[later] + number[number > 0].astype(np.uint64) * _SEED)
    return out


def _sparse(hits: np.ndarray) -> np.ndarray:
    """Places of the few true values of a table whose rows are multiples of eight."""
    words = np.flatnonzero(hits.reshape(-1).view(np.uint64))
    found = np.flatnonzero(hits.reshape(-1, 8)[words])
    return words[found >> 3] * 8 + (found & 7)


class Sketcher:
    def __init__(self, k: int = K, m: int = FUNCTIONS, picks: int = PICKS, seed: int = 5):
        self.k, self.m, self.picks = k, m, picks
        self.odd = np.random.default_rng(seed).integers(1, 2**32, m, dtype=np.int64).astype(np.uint32) | np.uint32(1)

    def select(self, x: np.ndarray) -> np.ndarray:
        """functions x picks places of ``x``, ascending: those of least product with the function's odd number (ties: first)."""
        short, n, need = (x >> np.uint64(32)).astype(np.uint32), len(x), min(self.picks, len(x))
        limit = (1 << 32) * ENOUGH * need // n
        while True:
            which, places, values = [], [], []
            for a in range(0, n, SIDE):
                part = short[a : a + SIDE]
                width = -(-len(part) // 8) * 8
                product = np.empty((self.m, width), np.uint32)
                np.multiply(self.odd[:, None], part[None, :], out=product[:, : len(part)])
                hits = np.zeros((self.m, width), bool)
                np.less_equal(product[:, : len(part)], np.uint32(min(limit, 2**32 - 1)), out=hits[:, : len(part)])
                at = _sparse(hits)
                which.append(at // width)
                places.append(at % width + a)
                values.append(product.reshape(-1)[at])
            j, place, value = map(np.concatenate, (which, places, values))
            if np.bincount(j, minlength=self.m).min() >= need:
                break
            limit *= 8
        order = np.lexsort((place, value, j))
        j, place = j[order], place[order]
        first = np.searchsorted(j, np.arange(self.m))
        return np.sort(place[first[:, None] + np.arange(need)], axis=1)

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        out = np.full(self.m, _SEED)
        if len(h):
            x = numbered(h)
            for column in self.select(x).T:
                out = mix(out * _M1 + x[column])
        return (out >> np.uint64(32)).astype("<u4")

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The fingerprint of each of several texts that lie one after the other."""
        every, out = kmer_hashes(data, self.k), []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if 0 < b - a < self.k:
                h = np.frombuffer(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), np.uint64)
            else:
                h = every[a : b - self.k + 1] if b > a else every[:0]
            out.append(self.of_hashes(h))
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _head(text: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` code points (all, if fewer)."""
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    return text[: starts[n]] if n < len(starts) else text


def fingerprints(df: DataFrame, text: str = "text", k: int = K, m: int = FUNCTIONS, picks: int = PICKS) -> DataFrame:
    """``df`` with ``fingerprint``, ``8 * m`` hex digits; without a shuffle."""
    sketcher = Sketcher(k, m, picks)

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd
        import pyarrow as pa

        data, offsets = string_bytes(pa.Array.from_pandas(texts, type=pa.string()))
        return pd.Series([x.tobytes().hex() for x in sketcher.texts(data, offsets)], dtype=object)

    bounded_batches(df.sparkSession)
    return df.withColumn("fingerprint", run(F.col(text)))


class _Row:
    """A document in its range, with what its neighbours need of it."""

    __slots__ = ("key", "text", "repeats", "copy", "range", "sketch")

    def __init__(self, key, text, repeats, copy, range_, sketch):
        self.key, self.text, self.repeats, self.copy, self.range, self.sketch = key, text, repeats, copy, range_, sketch


_FOUND = "key long, repeats long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(sketcher: Sketcher, pairs: list[tuple[_Row, _Row, int]]):
    """A batch of results for rows, the rows that follow them, and the number of rows each stands for."""
    import pyarrow as pa

    texts, chars = [], []
    for row, following, _ in pairs:
        n = int(((row.text & 0xC0) != 0x80).sum())
        chars.append(n)
        texts.append(np.concatenate([_head(row.text, n - n // 2), _head(following.text, n // 2)]))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.concatenate([*texts, np.zeros(0, np.uint8)])
    sketches = sketcher.texts(data, offsets)
    columns = [
        pa.array([r.key for r, _, _ in pairs], pa.int64()), pa.array([n for _, _, n in pairs], pa.int64()), pa.array(chars, pa.int64()),
        pa.array([hashlib.sha256(t.tobytes()).hexdigest() for t in texts]), pa.array([r.sketch.tobytes().hex() for r, _, _ in pairs]), pa.array([s.tobytes().hex() for s in sketches]),
        pa.array([likeness(r.sketch, s) for (r, _, _), s in zip(pairs, sketches, strict=True)], pa.float64()), pa.array([likeness(r.sketch, f.sketch) for r, f, _ in pairs], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])


def ranges_of(cuts: list[tuple[int, int, int]], empty: np.ndarray, place: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The number of cuts up to each key (without key, complement of the key, hash of the text)."""
    first = np.array([c[1] for c in cuts if not c[0]], np.int64)
    low, out = np.searchsorted(first, place, "left"), np.searchsorted(first, place, "right")
    for i in np.flatnonzero((low != out) | empty):
        out[i] = bisect_right(cuts, (int(empty[i]), int(place[i]), int(hashed[i])))
    return out


def followed(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = FUNCTIONS, picks: int = PICKS) -> DataFrame:
    """``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark: SparkSession = df.sparkSession
    bounded_batches(spark)
    result = f"{key} long, {_FOUND.partition('repeats long, ')[2]}"
    # ascending places are descending keys: ~key has no overflow
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("key", F.col("key").isNull().cast("int").alias("empty"), F.coalesce(F.bitwise_not("key"), F.lit(0)).alias("place"), F.xxhash64("text").alias("hashed"), "text")
    order = ["empty", "place", "hashed"]
    keys = durable(docs.groupBy(*order).count())
    total, most = keys.agg(F.sum("count"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], result)
    count = max(1, min(RANGES * partitions(spark), SAMPLE // 16, most))
    drawn = F.pmod(F.xxhash64(*order), F.lit(1 << 40))
    chance = int(min(1.0, 1.2 * SAMPLE / most) * (1 << 40))
    sample = sorted(tuple(r) for r in keys.filter(drawn <= chance).orderBy(drawn, *order).limit(SAMPLE).select(*order).collect())
    cuts = sorted({sample[i * len(sample) // count] for i in range(1, count)})

    @F.pandas_udf("long")
    def dealt(empty, place, hashed):
        import pandas as pd

        return pd.Series(ranges_of(cuts, empty.to_numpy().astype(bool), place.to_numpy(), hashed.to_numpy()))

    firsts = sorted((r["range"], tuple(r.least)) for r in keys.withColumn("range", dealt(*order)).groupBy("range").agg(F.min(F.struct(*order)).alias("least")).collect())  # a row a range
    before = [(*least, firsts[i - 1][0]) for i, (_, least) in enumerate(firsts)]
    # more rows than a range holds: at most as many keys as ranges, and the same for the firsts
    hot = F.broadcast(spark.createDataFrame(keys.filter(F.col("count") > max(1000, total // count)).select(*order).collect(), "empty int, place long, hashed long"))
    plain = docs.join(hot, order, "left_anti").withColumn("repeats", F.lit(1).cast("long"))
    once = docs.join(hot, order, "left_semi").groupBy("key", *order).agg(F.first("text").alias("text"), F.count("*").alias("repeats"))
    own = plain.unionByName(once).withColumn("range", dealt(*order)).withColumn("copy", F.lit(0))
    edges = docs.join(F.broadcast(spark.createDataFrame(before, "empty int, place long, hashed long, range long")), order)
    edges = edges.groupBy("key", *order, "range").agg(F.first("text").alias("text")).withColumns({"repeats": F.lit(0).cast("long"), "copy": F.lit(1)})
    rows = own.unionByName(edges).repartition(partitions(spark), "range").sortWithinPartitions("range", "copy", *order)

    def run(batches: Iterator) -> Iterator:
        sketcher, last = Sketcher(k, m, picks), None
        for b in batches:
            data, offsets = string_bytes(b.column(1))
            pairs = []
            for key_, at, repeats, copy, range_, sketch in zip(b.column(0).to_pylist(), range(len(offsets) - 1), *(b.column(i).to_pylist() for i in (2, 3, 4)), sketcher.texts(data, offsets), strict=True):
                row = _Row(key_, data[offsets[at] : offsets[at + 1]], repeats, copy, range_, sketch)
                if last is not None and last.range == range_ and not last.copy:
                    pairs.append((last, row, 1))
                if repeats > 1:  # rows that are followed by their like
                    pairs.append((row, row, repeats - 1))
                last = row
            if pairs:
                yield _edited(sketcher, pairs)
            if last is not None:  # keeps its own bytes only, not the batch's
                last.text = last.text.copy()

    found = rows.select("key", "text", "repeats", "copy", "range").mapInArrow(freed(run), _FOUND)
    out = found.withColumn("_tw_row", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    return out.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
