"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A folder holds ``shards`` and ``dictionary``, both Parquet written by Spark (so
a lost executor's work is redone and committed once). A shard row has, for a run
of documents in ascending doc_id order, the concatenated frames (``payload``),
the offset index (``entries``: per document its id, token count, and the place
and length of its frame), the bytes of an id, and the SHA-256 of the dictionary.
A document is read by its entry alone.

Null and empty texts are documents with the end id only. Rows that repeat a
doc_id are all kept, ordered by a hash of their text. Rows with a null doc_id come
first and are flagged in their entries. Texts are encoded whole, of any length below
4 GB of ids. Other columns are not read. An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.bpe import Memo, byte_letters, matches
from tabweave.llm.common import MARKS, Words, WordTable, bounded_batches, freed, marked, mix, partitions, pieces, small_or_not, spread, string_bytes, word_hashes
from tabweave.storage import scratch as scratch_folder  # noqa: F401 (a new folder in the shared one)

ENTRY = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u4"), ("length", "<u4"), ("place", "<u4"), ("flags", "<u4")])
SHARD_BYTES, SHARD_DOCS = 4 << 20, 8192
#: The dictionary is trained on the whole arrays of at most so many documents (chosen by a hash of their id among those of at most so many bytes).
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 64 << 10, 64 << 10
MATCHES = 120_000
_ID = attrgetter("id")
SHARDS = "part int, shard int, first_id long, last_id long, n_docs long, n_tokens long, width int, dictionary string, entries binary, payload binary"


#: Fixed value: the byte-level pattern of the tokenizers library, with its white space spelled out.
_WHITE = r"\t-\r\x85\p{Z}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


class Encoder:
    """The tokenizers library's BPE model behind a table of units and a memo of pattern matches.

    No match of the byte-level pattern joins a word with white space after it. A
    text whose white space characters are single blanks and line breaks between
    words may thus be cut before each into units, which are looked up by their hash
    for a whole batch, without the mark that may end them. Other texts are cut by the pattern, and those with a special
    token's string go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PATTERN)
        self.letters, self.model = byte_letters(), self.library.model
        self.match = Memo(self._match, MATCHES)
        self.table = WordTable(self.width)
        self.leads = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.leads[[i for token, i in self.library.get_vocab().items() if token.startswith(self.letters[32])]] = True
        self.marks, self.single = np.zeros(256, self.width), np.zeros(256, bool)
        for c in MARKS:
            self.marks[ord(c)], self.single[ord(c)] = self.match[c][0], len(self.match[c]) == 1

    def _match(self, match: str) -> list[int]:
        letters = match.encode().decode("latin-1").translate(self.letters)
        return list(map(_ID, self.model.tokenize(letters)))

    def _by_pattern(self, text: str) -> list[int]:
        return [i for m in matches(self.pattern, text) for i in self.match[m]]

    def _slowly(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width)
        return np.array(self._by_pattern(text), self.width)

    def encode(self, text: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts in a byte buffer."""
        n, raw = len(offsets) - 1, text.tobytes()
        w = Words(text, offsets, fold=False)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        white = (text <= 32) & ((text == 32) | ((text >= 9) & (text <= 13)))
        # texts with white space in a row, at an end, or of another kind than blanks and line breaks
        odd = white & (text != 32) & (text != 10)
        odd |= np.isin(text, (0xE1, 0xE2, 0xE3)) | ((text == 0xC2) & np.isin(np.append(text[1:], 0), (0x85, 0xA0)))
        odd[1:] |= white[1:] & white[:-1]
        ends = np.concatenate([offsets[:-1], offsets[1:] - 1])[np.tile(np.diff(offsets) > 0, 2)]
        odd[ends] |= white[ends]
        slow = np.zeros(n, bool)
        slow[owner[odd]] = True
        if any(s.encode() in raw for s in self.special):
            slow |= np.array([any(s.encode() in raw[i:j] for s in self.special) for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
        counts = np.diff(w.first)
        take = np.flatnonzero(np.repeat(~slow, counts))
        start = w.start[take]
        mark = (marked(w) & self.single[w.text[w.end - 1]])[take] if len(w.text) else np.zeros(0, bool)
        last, end = w.end[take] - 1, w.end[take] - mark
        initial = np.isin(start, offsets)
        lead = np.where(initial, 0, text[np.maximum(start - 1, 0)]).astype(np.uint64) if len(start) else np.zeros(0, np.uint64)

        def make(i: int) -> list[int]:
            unit = raw[start[i] - (not initial[i]) : end[i]].decode()
            body = unit[1:]
            # most units are one word, which needs no search
            if unit[0] == " " and body.isalpha():
                return self.match[unit]
            if unit[0] == "\n" and body.isalpha():
                return self.match["\n"] + self.match[body]
            return self._by_pattern(unit)

        def made(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # units after a blank are encoded in one go, each from the id that begins with the blank
            units = at[lead[at] == 32].tolist()
            if len(units) == len(at):
                found = np.array(self.library.encode_batch_fast([b"".join([raw[start[i] - 1 : end[i]] for i in units]).decode()], add_special_tokens=False)[0].ids, self.width)
                starts = np.flatnonzero(self.leads[found])
                if len(starts) == len(units):
                    return found, np.diff(np.append(starts, len(found)))
            elif units:
                (a, m), (b, n) = made(np.array(units)), made(at[lead[at] != 32])
                sizes = np.empty(len(at), np.int64)
                sizes[lead[at] == 32], sizes[lead[at] != 32] = m, n
                begin = np.empty(len(at), np.int64)
                begin[lead[at] == 32], begin[lead[at] != 32] = np.cumsum(m) - m, len(a) + np.cumsum(n) - n
                return np.concatenate([a, b])[spread(begin, sizes)], sizes
            one_by_one = [make(i) for i in at.tolist()]
            return np.fromiter(chain.from_iterable(one_by_one), self.width), np.fromiter(map(len, one_by_one), np.int64, len(one_by_one))

        ids, sizes = self.table.encode(mix(word_hashes(text, start, end) + lead * np.uint64(0x9E3779B97F4A7C15)), made)
        ids = np.insert(ids, np.cumsum(sizes)[mark], self.marks[text[last[mark]]])
        at = np.concatenate([[0], np.cumsum(sizes + mark)])[np.concatenate([[0], np.cumsum(np.where(slow, 0, counts))])]
        return [self._slowly(raw[offsets[k] : offsets[k + 1]].decode()) if slow[k] else ids[at[k] : at[k + 1]] for k in range(n)]

    def encode_column(self, column) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        text, offsets = string_bytes(column)
        for i, j in pieces(offsets):
            yield i, j, self.encode(text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _with_end(ids: np.ndarray, width: str, end: int) -> bytes:
    return ids.tobytes() + np.array([end], width).tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end: int) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES from a bounded sample of serialized id arrays."""
    import zstandard

    docs = docs.filter(F.coalesce(F.octet_length("_tw_text"), F.lit(0)) <= SAMPLE_BYTES)
    total = docs.count()
    share = min(1.0, 1.5 * SAMPLE_DOCS / max(total, 1))
    place = F.xxhash64("_tw_id", F.octet_length("_tw_text"))
    sample = docs.filter(F.pmod(place, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(place, "_tw_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_with_end(x, e.width, end)for _, _, texts in e.encode_column(b.column(1)) for x in texts], pa.binary())], names=["ids"])

    samples = [bytes(r.ids) for r in sample.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few documents to train on
        return b"".join(samples)[:DICTIONARY_BYTES]


def write(df: DataFrame, folder: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Writes ``df``'s texts as token-id files in ``folder``, which all executors must reach."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("_tw_id"), F.col(text).alias("_tw_text"))
    words = train_dictionary(docs, tokenizer, end)
    sha = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(sha, bytearray(words))], "dictionary string, bytes binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        e = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        part, shard = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        frames: list[bytes] = []
        place = 0

        def flush():
            nonlocal rows, frames, place, shard
            entries = np.array(rows, ENTRY)
            named = entries["doc_id"][entries["flags"] == 0]
            out = (part, shard, int(named[0]) if len(named) else None, int(named[-1]) if len(named) else None, len(rows), int(entries["n_tokens"].sum(dtype=np.int64)), int(e.width[2]), sha, entries.tobytes(), b"".join(frames))
            rows, frames, place, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for b in batches:
            for first, last, texts in e.encode_column(b.column(1)):
                for i, ids in zip(b.column(0)[first:last].to_pylist(), texts, strict=True):
                    ids = _with_end(ids, e.width, end)
                    frames.append(frame := pack.compress(ids))
                    rows.append((i or 0, len(ids) // int(e.width[2]), len(frame), place, i is None))
                    place += len(frame)
                    if place >= SHARD_BYTES or len(rows) >= SHARD_DOCS:
                        yield flush()
        if rows:
            yield flush()

    order = ("_tw_id", F.xxhash64("_tw_text"))
    ordered = docs.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "_tw_text")
    ordered.mapInArrow(freed(run), SHARDS).write.mode("overwrite").parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32 bits)."""
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    words = {r.dictionary: bytes(r.bytes) for r in spark.read.parquet(f"{folder}/dictionary").collect()}
    sizes = shards.select("part", "shard", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = sizes.withColumn("within", within).join(by_part, "part").select("part", "shard", (F.col("base") + F.col("within")).alias("_tw_start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        opened = {}
        for b in batches:
            for r in b.to_pylist():
                sha = r["dictionary"]
                if sha not in opened:
                    if hashlib.sha256(words[sha]).hexdigest() != sha:
                        raise ValueError("the dictionary differs from the one that the shard was written with")
                    opened[sha] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words[sha]) if words[sha] else None)
                entries, start = np.frombuffer(r["entries"], ENTRY), r["_tw_start"]
                starts = start + np.cumsum(entries["n_tokens"], dtype=np.int64) - entries["n_tokens"]
                view, crcs, all_ids = memoryview(r["payload"]), [], []
                for x in entries:
                    ids = np.frombuffer(opened[sha].decompress(view[int(x["place"]) : int(x["place"]) + int(x["length"])]), f"<u{r['width']}").astype("<u4").tobytes()
                    crcs.append(zlib.crc32(ids))
                    if with_ids:
                        all_ids.append(ids)
                yield pa.RecordBatch.from_arrays([pa.array(entries["doc_id"].astype(np.int64), mask=entries["flags"] > 0), pa.array(starts.astype(np.int64)), pa.array(entries["n_tokens"].astype(np.int64)), pa.array(crcs, pa.int64())] + [pa.array(all_ids, pa.binary())] * with_ids, names=names)

    bounded_batches(spark)
    placed = shards.join(small_or_not(starts), ["part", "shard"]).select("entries", "payload", "width", "dictionary", "_tw_start")
    return placed.mapInArrow(freed(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
