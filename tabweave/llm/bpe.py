"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the *last* token of its encoding is unique. The
tokens that end at a place, the suffixes of the prefix, are what an automaton over
the vocabulary reports (of the Aho-Corasick kind, which also follows suffix links);
a match is the last token of its prefix exactly if it is compatible
with the last token of the prefix before it, that is, if merging the two tokens'
symbols gives these two tokens again. Back-pointers then yield the ids. Each distinct
word is encoded once as long as a worker's table (``WordTable``) has room for it.

Texts are encoded whole. Null texts are empty: no ids, empty decoded text.
Strings of special tokens inside a text become those tokens, as in the
tokenizers library. The given files' layouts are read from their JSON.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tabweave.llm.common import GAP, MARKS, Words, WordTable, bounded_batches, freed, marked, pieces, release, string_bytes, word_hashes

#: A last symbol with the word-end mark is shifted into a private range, so that it is one character.
_END = 0xF0000
#: Entries of a worker's memos of pieces and of tokens' edges; a full one becomes the old generation.
MEMO = 20_000
#: Token pairs whose test a worker remembers; beyond, it starts anew.
PAIRS = 150_000
_NEVER = 1 << 60
#: First bytes of characters among which are combining marks.
_COMBINING = np.zeros(256, bool)
_COMBINING[[0xCC, 0xCD, *range(0xD2, 0xF5)]] = True
#: Unicode white space as a character class.
_WHITE = r"\t-\r\x85\p{Z}"
#: Letters below this character are the same in all Unicode tables.
_LATIN = "\u0250"
_GAP = re.compile(GAP)


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others are shifted up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """A dict that computes what it misses. When full it becomes the old generation, from which
    entries still in use are taken over."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Letters and digits of the regex module's Unicode tables that the tokenizers library's tables (16.0) don't have.
NEWER = """
0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff
18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_NEWER = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]")


def matches(pattern, text: str) -> list[str]:
    """All matches of a pattern of the regex module, with the characters of ``NEWER`` as neither letters nor digits."""
    if text.isascii() or not _NEWER.search(text):
        return pattern.findall(text)
    return [text[slice(*m.span())] for m in pattern.finditer(_NEWER.sub("\ufffd", text))]


class Codec:
    """Encoder and decoder for a word-level BPE file with a word-end suffix and no decoder part."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, parts = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = {}
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split = regex.compile(parts[0]["pattern"]["Regex"].replace(r"\s", _WHITE))
        self.white = regex.compile(f"[{_WHITE}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.rank = {(self._symbols(a), self._symbols(b)): i for i, (a, b) in enumerate(model["merges"])}
        self.parts = {sys.intern(a + b): (a, b, i) for (a, b), i in reversed(self.rank.items())}
        self.left, self.right = Memo(lambda t: self._edge(t, 0)), Memo(lambda t: self._edge(t, 1))
        self.automaton = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            s = self._symbols(token)
            self.ids[s] = i
            self.automaton.add_word(s, (len(s), s, {}))  # the last holds which tokens may stand before
        self.automaton.make_automaton()
        self.known = 0
        self.piece = Memo(self._encode_piece)
        self.mark_ids = np.zeros(256, np.uint32)
        for mark in MARKS:
            self.mark_ids[ord(mark)] = np.frombuffer(self._encode_word(mark), "<u4")[0]
        self.table = WordTable("<u4")

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            token = body[:-1] + chr(_END + ord(body[-1]))
        return sys.intern(token)

    def _edge(self, token: str, side: int) -> tuple[tuple[str, int], ...]:
        """What stands at one side of the token while it is merged: from its outermost symbol to the token, each with the
        rank at which it is merged into the next one."""
        out, up = [], _NEVER
        while token in self.parts and len(token) > 1:
            out.append((token, up))
            *halves, up = self.parts[token]
            token = halves[side]
        return (*((t, u) for t, u in [(token, up), *reversed(out)]),)

    def compatible(self, before: str, token: str) -> bool:
        """Whether the two tokens' symbols merge to these two again: no merge over their border comes first.

        A merge's rank is above those of what it merges, so the parts at the border follow each other by rank. Of equal
        merges the left one comes first.
        """
        left, right, i, j = self.right[before], self.left[token], 0, 0
        rank = self.rank.get
        while True:
            (a, end_a), (b, end_b) = left[i], right[j]
            over = rank((a, b), _NEVER)
            if over < end_a and over <= end_b and over != _NEVER:
                return False
            if end_a <= end_b:
                if end_a == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _last_tokens(self, symbols: str) -> list[str]:
        last: list[str | None] = [None] * (len(symbols) + 1)
        last[0], known = "", self.known
        for end, (n, token, seen) in self.automaton.iter(symbols):
            if last[end + 1] is None:
                before = last[end + 1 - n]
                if before is None:
                    continue
                fits = seen.get(before)
                if fits is None:
                    fits = seen[before] = not before or self.compatible(before, token)
                    known += 1
                if fits:
                    last[end + 1] = token
        self.known = known
        if known > PAIRS:
            for _, _, seen in self.automaton.values():
                seen.clear()
            self.known = 0
        return last

    def _encode_word(self, word: str) -> bytes:
        """Ids (little-endian 32 bits) of a string without ASCII white space or special tokens."""
        if not word.isascii():
            word = self.white.sub(" ", unicodedata.normalize("NFC", word)).replace("Σ", "σ")
        word, piece = word.lower(), self.piece.__getitem__
        # most words are Latin letters, perhaps with one mark, which needs no search
        if word and max(word) < _LATIN:
            if word.isalpha():
                return piece(word)
            if word[-1] in MARKS and word[:-1].isalpha():
                return piece(word[:-1]) + piece(word[-1])
        return b"".join(map(piece, matches(self.split, word)))

    def _encode_piece(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1").translate(self.letters)
        if self.suffix:
            symbols = symbols[:-1] + chr(_END + ord(symbols[-1]))
        last, j, back = self._last_tokens(symbols), len(symbols), []
        while j:
            back.append(self.ids[last[j]])
            j -= len(last[j])
        return struct.pack(f"<{len(back)}I", *reversed(back))

    def encode(self, text: str) -> bytes:
        """Ids of one text, with the strings of special tokens as those."""
        parts = [text] if self.cut is None else self.cut.split(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else b"".join(map(self._encode_word, _GAP.split(x))) for x in parts)

    def encode_texts(self, text: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of the texts in a byte buffer. Words are looked up without the mark that ends them, and without regard to
        ASCII case unless a letter may be followed by a combining mark."""
        raw = text.tobytes()
        w = Words(text, offsets, fold=not _COMBINING[text].any())
        mark = marked(w)
        end = w.end - mark

        def body(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            codes = [self._encode_word(raw[i:j].decode()) for i, j in zip(w.start[at].tolist(), end[at].tolist(), strict=True)]
            return np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4

        ids, sizes = self.table.encode(word_hashes(w.text, w.start, end), body)
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.insert(ids, at[1:][mark], self.mark_ids[w.text[w.end[mark] - 1]])
        at = (4 * (at + np.concatenate([[0], np.cumsum(mark)]))[w.first]).tolist()
        codes = ids.tobytes()
        out = [codes[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        if special := [s for s in map(str.encode, self.special) if s in raw]:
            for k, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if any(s in raw[i:j] for s in special):
                    out[k] = self.encode(raw[i:j].decode())
        return out

    def encode_column(self, column) -> Iterator[tuple[int, int, list[bytes]]]:
        text, offsets = string_bytes(column)
        for i, j in pieces(offsets, 1 << 20):
            yield i, j, self.encode_texts(text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def decode(self, ids: bytes) -> str:
        """The tokens' names joined by blanks: what the library does without a decoder part."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
        release()  # what reading the file took
    return _CODECS[path]


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """One row per row: ``keys``, the ids (binary, little-endian unsigned 32 bits) and the decoded text.

    ``tokenizer`` is the path of the JSON file, which every executor must have.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(tokenizer)
        for batch in batches:
            for i, j, codes in c.encode_column(batch.column(len(keys))):
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[i:j] for k in range(len(keys))), pa.array(codes, pa.binary()), pa.array(map(c.decode, codes), pa.string())], names=[*keys, ids, decoded])

    source = df.select(*keys, F.col(text).alias("_tw_text"))
    schema = StructType([*(source.schema[k] for k in keys), StructField(ids, BinaryType()), StructField(decoded, StringType())])
    return source.mapInArrow(freed(run), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode_decode``'s rows."""
    return encoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
