import math
import re

import numpy as np
import pyarrow as pa

from tabweave.llm import quality_classifier as q
from tabweave.llm.common import Words, crc_mod, mix, string_bytes


def test_held_out_accuracy(spark):
    good, bad = "the quick brown fox jumps over a lazy dog ".split(), "BUY!! NOW$$$ *** CHEAP!! ###".split()
    rows = [(i, " ".join((good if i % 2 else bad)[(i * 7 + j * j) % 5] for j in range(20)), "x") for i in range(300)] + [(900, None, "x"), (901, "", "x"), (902, "word " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = q.fit(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    got = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert sum((got[i] >= 0.5) == i % 2 for i in range(300)) >= 295


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert q.score(docs, model).first().score == 0.5 and q.score(docs.limit(0), model).count() == 0


def test_scores_against_a_plain_version():
    texts = ["The cat the cat  sat.\nOn", "", None, "a", "ab", "é ß é", "x" * 70 + " y y y"]
    rng = np.random.default_rng(1)
    m = q.Model(rng.normal(size=1 << q.BITS), 0.25)
    got = m.score(*string_bytes(pa.array(texts, pa.string())))
    u = np.uint64
    for t, score in zip(texts, got, strict=True):
        raw = (t or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        hashes = [Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), fold=False).hash[0] for w in words]
        found = [*hashes]
        for a, b in zip(hashes, hashes[1:]):
            found.append(q._SAME if a == b else mix(np.array([a * u(3) + b], u))[0])
        plain = re.sub(rb"[\x09-\x0D]", b" ", raw)
        found += [mix(np.array([(a << 16 | b << 8 | c) + (1 << 40)], u))[0] for a, b, c in zip(plain, plain[1:], plain[2:])]
        margin = sum(m.margins[int(h) & ((1 << q.BITS) - 1)] for h in found) / max(1, len(found)) + m.bias
        assert math.isclose(score, 1 / (1 + math.exp(-margin)), rel_tol=1e-9)


def test_conflicting_labels_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, ("good text " if i % 2 else "bad thing ") * 9, "x") for i in range(40)] * 2, "doc_id long, text string, quality string")
    labels = [(i, i % 2) for i in range(40)]
    one, two = (q.fit(docs.drop("quality"), spark.createDataFrame(rows, "doc_id long, quality int")) for rows in (labels, labels + [(i, 0) for i in range(40)]))
    assert np.array_equal(one.margins, two.margins) and q.score(docs, one, keys=("doc_id", "quality")).count() == 80
