"""Quality classifier: supervised subword embeddings.

Every feature of a text (words, pairs of neighbouring words, byte trigrams with
word borders) is hashed to a bucket with a learned vector; a text is the mean of
its features' vectors, and a softmax layer gives the class. Training is
stochastic gradient descent in numpy on a bounded sample of labelled rows
(``SAMPLE`` per class, chosen by a hash of the key; of these, texts of more than ``SAMPLE_BYTES``
are left out, so that the sample is bounded in bytes too). Since the layers are linear
up to the softmax, scoring needs one margin per bucket, which is a table of
fixed size.

Texts are scored whole. Null and empty texts have no features and get the bias's
score. Without any labelled row every score is 0.5. Of several labels of one key the larger
one counts; labels other than 0 and 1 and null keys are ignored. Rows that repeat are scored one
by one, and all rows of a sampled key are learned from. Columns of the input other than keys and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tabweave.llm.common import Words, bounded_batches, freed, mix, pieces, string_bytes

BITS, DIM = 17, 8
SAMPLE, SAMPLE_BYTES, EPOCHS, RATE = 1500, 32 << 10, 5, 0.5
_SAME = np.uint64(0x5EED)


def features(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, grouped by text, and where each text's begin."""
    mask, n = np.uint64((1 << BITS) - 1), len(offsets) - 1
    w = Words(text, offsets, fold=False)
    of_word = np.repeat(np.arange(n), np.diff(w.first))
    pair = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:]) if len(w.hash) else w.hash
    if len(pair):
        pair[w.hash[:-1] == w.hash[1:]] = _SAME  # any immediate repetition is one feature
        inner = of_word[:-1] == of_word[1:]
        pair, of_pair = pair[inner], of_word[1:][inner]
    else:
        of_pair = of_word
    b = np.where((text >= 9) & (text <= 13), 32, text).astype(np.uint64)
    of_byte = np.repeat(np.arange(n), np.diff(offsets))
    tri = mix((b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) + np.uint64(1 << 40)) if len(b) > 2 else b[:0]
    of_tri = of_byte[: len(tri)]
    inner = of_tri == of_byte[2:] if len(tri) else np.zeros(0, bool)
    ids = np.concatenate([w.hash, pair, tri[inner]]) & mask
    owner = np.concatenate([of_word, of_pair, of_tri[inner]])
    order = np.argsort(owner, kind="stable")
    return ids[order].astype(np.int64), np.searchsorted(owner[order], np.arange(n + 1))


@dataclass
class Model:
    margins: np.ndarray
    bias: float

    def score(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, first = features(text, offsets)
        total = np.concatenate([[0.0], np.cumsum(self.margins[ids], dtype=np.float64)])
        count = np.diff(first)
        logit = (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """``bags``: distinct buckets, their counts, and the class (0 or 1) of each text."""
    rng = np.random.default_rng(seed)
    if not bags:
        return Model(np.zeros(1 << BITS), 0.0)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    out, bias = rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            ids, counts, label = bags[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = counts / counts.sum() if len(counts) else counts
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM)
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum() - np.eye(2)[label]
            back = error @ out
            out -= rate * np.outer(error, hidden)
            bias -= rate * 0.1 * error
            if len(ids):
                vectors[ids] -= (rate * 20) * share[:, None] * back
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows of each class; ``labels`` must hold training rows only."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_tw_key"), F.col(label).cast("int").alias("_tw_label")).groupBy("_tw_key").agg(F.max("_tw_label").alias("_tw_label"))
    picked = [chosen.filter(F.col("_tw_label") == c).orderBy(F.xxhash64("_tw_key"), "_tw_key").limit(sample) for c in (0, 1)]
    rows = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * sample rows
    short = F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES
    source = docs.filter(short).select(F.col(key).alias("_tw_key"), F.col(text).alias("_tw_text")).join(rows, "_tw_key").select("_tw_text", "_tw_label", "_tw_key")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            data, offsets = string_bytes(b.column(0))
            ids, first = features(data, offsets)
            bags = [np.unique(ids[i:j], return_counts=True) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array([x.astype(np.int32).tobytes() for x, _ in bags], pa.binary()), pa.array([x.astype(np.int32).tobytes() for _, x in bags], pa.binary())], names=["_tw_key", "label", "ids", "counts"])

    schema = StructType([source.schema["_tw_key"]]).add("label", "integer").add("ids", "binary").add("counts", "binary")
    got = sorted(source.mapInArrow(freed(run), schema).collect(), key=lambda r: (r["_tw_key"], bytes(r.ids)))
    return train([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.int32), r.label) for r in got])


def score(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keys`` and the probability of class 1 of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.margins.astype(np.float32), model.bias))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = Model(*shared.value)
        for b in batches:
            data, offsets = string_bytes(b.column(len(keys)))
            scores = [m.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*keys, name])

    source = docs.select(*keys, F.col(text).alias("_tw_text"))
    return source.mapInArrow(freed(run), StructType([*(source.schema[k] for k in keys), StructField(name, DoubleType())]))
