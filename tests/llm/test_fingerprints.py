import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import fingerprints as f
from tabweave.llm.common import mix


def one(x):
    return int(mix(np.array([x % 2**64], np.uint64))[0])


def kmer(piece, k):
    """The hash of a k-mer by Python integers."""
    if len(piece) < k:
        return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")
    if k < 8:
        return one(int.from_bytes(piece, "little"))
    h = int(f._SEED)
    for at in [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h = ((h ^ int.from_bytes(piece[at : at + 8], "little")) * int(f._M1)) % 2**64
        h ^= h >> 32
    return h * int(f._M2) % 2**64


def plain(text, k, m, picks):
    """Order MinHash one function and one k-mer at a time."""
    data, seen, x = text.encode(), {}, []
    for i in range(max(len(data) - k + 1, min(1, len(data)))):
        piece = data[i : i + k]
        h, n = kmer(piece, k), seen.get(piece, 0)
        x.append(one(h + n * int(f._SEED)) if n else h)
        seen[piece] = n + 1
    out = b""
    for odd in f.Sketcher(k, m, picks).odd.tolist():
        chosen = sorted(range(len(x)), key=lambda i: ((x[i] >> 32) * odd % 2**32, i))[:picks]
        t = int(f._SEED)
        for i in sorted(chosen):
            t = one(t * int(f._M1) + x[i])
        out += (t >> 32).to_bytes(4, "little")
    return out.hex()


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(80)]
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(40)]
    return ["", None, "a", "é", "aé€😀", "ab" * 300, "x" * 5000, "fifteen bytes..", "sixteen bytes...", *prose, prose[0], prose[1] + "é" * 31]


@pytest.mark.parametrize(("k", "m", "picks"), [(16, 64, 2), (5, 8, 3), (11, 16, 1)])
def test_against_one_at_a_time(spark, k, m, picks):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, t string").repartition(3)
    got = {r.doc_id: r.fingerprint for r in f.fingerprints(df, "t", k, m, picks).collect()}
    assert got == {i: plain(t or "", k, m, picks) for i, t in enumerate(rows)}


def expected(rows, k=16, m=64, picks=2):
    """rows: key and text in their order."""
    share = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 8 * m, 8)) / m
    out = []
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        a, b, c = (plain(t, k, m, picks) for t in (text, edited, following))
        out.append((str(key), n, hashlib.sha256(edited.encode()).hexdigest(), a, b, round(share(a, b), 9), round(share(a, c), 9)))
    return sorted(out)


def followed(spark, rows, parts=4):
    df = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "doc_id long, text string, fingerprint string, `range` int, place string").repartition(parts, F.rand(1))
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in f.followed(df).collect())


def test_every_row_meets_the_next(spark):
    rows = list(enumerate(texts()))
    assert followed(spark, rows) == expected(rows[::-1])
    assert followed(spark, rows[:1]) == expected(rows[:1])
    assert followed(spark, rows[9:11]) == expected([rows[10], rows[9]])
    assert followed(spark, []) == []


def test_order_of_extremes_repeats_and_rows_without_key(spark):
    rows = [(2**63 - 1, "largest " * 9), (5, "five " * 20), (-(2**63), "smallest " * 7), (None, "no key " * 11)]
    assert followed(spark, rows) == expected(rows)
    same = [(7, "seven " * 30)] * 3000  # interchangeable rows, sent once
    assert followed(spark, [(9, "nine " * 30), *same, (1, "one " * 50)]) == expected([(9, "nine " * 30), *same, (1, "one " * 50)])
    two = [(3, "three " * 12), (3, "drei " * 12)]
    assert followed(spark, two) in (expected(two), expected(two[::-1]))


def test_likeness_falls_with_edits_and_with_order():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(4000)]
    s = f.Sketcher()
    of = lambda w: s.of_hashes(f.kmer_hashes(np.frombuffer(" ".join(w).encode(), np.uint8), s.k)[: -s.k + 1])
    base = of(words[:1000])
    few, half = of([*words[:500], words[3999], *words[501:1000]]), of([*words[:500], *words[2000:2500]])
    swapped, other = of([*words[500:1000], *words[:500]]), of(words[2000:3000])
    assert f.likeness(base, of(words[:1000])) == 1.0
    assert f.likeness(base, few) > 0.9 > f.likeness(base, half) > 0
    assert f.likeness(base, other) == 0
    assert f.likeness(base, swapped) < 0.8  # the same set of k-mers but for a few, in another order
