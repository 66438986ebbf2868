"""The pipeline's rows against plain versions of its stages: rules and copies by loops, mixing by SQL, ids by the library."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tabweave.llm import mixing
from tabweave.llm.quality_rules import STOP_WORDS
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"
STOP = {w for words in STOP_WORDS.values() for w in words}


def passes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    runs = [tuple(words[i : i + 3]) for i in range(n - 2)]
    times = Counter(runs)
    again = {j for i, r in enumerate(runs) if times[r] > 1 for j in (i, i + 1, i + 2)}
    if n < 50 or 100 * len(again) > 50 * n:
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda chars: sum(c in chars for c in text)
    return (
        1.5 <= sum(map(len, words)) / n <= 20 and count("#*$%&|<>") / n <= 0.2 and count("!") / n <= 0.5 and sum(w.lower() in STOP for w in words) / n >= 0.01
        and (len(lines) - len(set(lines))) / len(lines) <= 0.5
    )


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the sample tables")
def test_run_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in corpus_pipeline.known_language(spark, docs, SF).collect()]
    rows = [r for r in rows if passes(r["text"])]
    assert len(rows) > 100
    group = brute([(r["doc_id"], r["text"]) for r in rows], 5, 80, 100)
    rows = pd.DataFrame([r for r in rows if group[r["doc_id"]][1] == r["doc_id"]])
    con = duckdb.connect()
    con.register("kept_rows", rows)
    kept = {x for (x,) in con.sql(f"WITH {mixing.sql('kept_rows')} SELECT doc_id FROM mixed WHERE kept").fetchall()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in rows.itertuples() if r.doc_id in kept}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
