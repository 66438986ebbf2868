import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabweave.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CASES = ["", " ", "  ", "a  b", "a   b", "a \n b\n", "x    y ", "it's<|endoftext|> ok", "\n\n a", " \nb", "Éan de aiê\tfoo\r\n bar  ", "one two" * 2000, "a\x1cb c\x85d \u00a0e", "x\n", "\nx y", "日本 語 é"]


def same(texts):
    found = [x for _, _, part in token_files.encoder(PATH).encode_column(pa.array(texts, pa.string())) for x in part]
    for t, got in zip(texts, found, strict=True):
        assert got.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, repr(t)


def test_cases():
    same(CASES)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab' \n\t .", max_size=30)), max_size=4))
def test_any_text(texts):
    same(texts)


def test_round_trip(spark, tmp_path):
    rows = [(7 * i % 101, t, 1) for i, t in enumerate(CASES)] + [(200, None, 1)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string, start int"), str(tmp_path), PATH)
    got = sorted(token_files.read(spark, str(tmp_path), with_ids=True).collect())
    start = 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_empty(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path), PATH)
    assert token_files.read(spark, str(tmp_path)).count() == 0


def thue_morse(n):
    """A word over a and b and its complement, on which hashes by sums of powers modulo 2**64 agree."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_power_sums():
    same([" ".join([*thue_morse(n), "x", *thue_morse(n)[::-1]]) for n in (16, 1024, 2048)])


def test_null_and_repeated_ids_and_long_texts(spark, tmp_path):
    rows = [(None, "no id"), (-3, "minus"), (4, "b"), (4, "a"), (4, "a"), (None, None), (9, "long word " * 60_000), (0, "zero")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path), PATH)
    got = token_files.read(spark, str(tmp_path), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -3, 0, 4, 4, 4, 9]
    want = sorted((i is not None, i or 0, LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
