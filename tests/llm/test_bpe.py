import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabweave.llm.bpe import codec, digests, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CASES = ["", " ", "Hello World's 123!! don't", "thththonble  tiouwh,\n\tÉan de aiê ÇA ß ẞ ΟΔΟΣ Σ", "a<|endoftext|>b <|startoftext|>", "é  x y\x1cz\x85q", "日本語 ﷺ 😀👩‍👩‍👧", "x" * 3000, "<w></w> w>", "İstanbul ǅ", "J\u030c a\u00a0b \u3000 c\u2003", "ab" * 40 + " " + "ba" * 40]


def same(text):
    c, want = codec(PATH), LIBRARY.encode(text, add_special_tokens=False).ids
    for got in (c.encode(text), next(c.encode_column(pa.array([text, "x", text])))[2][2]):
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert c.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


def test_cases():
    for text in CASES:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdefgthonreis 'IT.,!<>/w\n", max_size=80)))
def test_any_text(text):
    same(text)


def test_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(99, None, "x")], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in digests(encode_decode(df, PATH)).collect()}
    assert len(rows) == len(CASES) + 1 and rows[99].n_tokens == 0 and rows[0].ids_sha256 == rows[99].ids_sha256
    assert digests(encode_decode(df.limit(0), PATH)).count() == 0
