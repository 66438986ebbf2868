"""Shared helpers: tables, word hashing, size-checked broadcasts, checkpoints."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.storage import materialised

#: Words are runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch, so that a batch of long texts fits a Python worker.
ARROW_ROWS = 256
#: Largest table (rows) that is ever broadcast; larger ones take a shuffle join.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limits the rows and bytes, and so the memory, of the batches sent to Python workers.

    Stages run when the caller asks for rows, so the limits stay on the session. They are the same for all operators, whose order
    therefore doesn't matter; those that want larger batches put them together in the worker (``regrouped``).
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def durable(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder, so lost executors don't undo it."""
    return materialised(df)


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def crc_mod(column: Column | str, modulus: int) -> Column:
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; when a task's rows end, its worker, which waits for other tasks, gives freed memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def regrouped(batches: Iterator, rows: int) -> Iterator:
    """The same rows in batches of at least ``rows`` (but for the last), so that array work doesn't depend on the session's batch size."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def release() -> None:
    """Returns memory that the allocators of Arrow and C hold but don't use."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held() -> None:
    """Lets C's allocator keep up to 128 MB that arrays gave back for the next ones, in place of returning each array's pages to the system
    and having them zeroed again; ``release`` returns them."""
    set_ = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_ is not None:
        set_(-3, 32 << 20)  # M_MMAP_THRESHOLD: larger arrays are mapped by themselves
        set_(-1, 128 << 20)  # M_TRIM_THRESHOLD


# --- hashing the words of an Arrow string column ---------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CODE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


#: Words of at most so many bytes are hashed side by side, byte by byte; longer ones one at a time.
SHORT = 32


def word_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges. Every byte goes through a multiplication and a shift, so that, unlike for sums of
    powers, no construction of equal hashes is known to hold for all words; two given words share one with odds of about 2**-64."""
    size = np.minimum(end - start, SHORT + 1).astype(np.uint8)
    order = np.argsort(size, kind="stable")
    upto = np.cumsum(np.bincount(size, minlength=SHORT + 2))  # words of at most so many bytes
    places, h = start[order[: upto[SHORT]]], np.full(upto[SHORT], _MIX)
    for k in range(SHORT):
        a = upto[k]
        if a == len(h):
            break
        x = (h[a:] ^ _CODE[text[places[a:] + k]]) * _MUL
        h[a:] = x ^ (x >> np.uint64(32))
    out = np.empty(len(start), np.uint64)
    out[order[: len(h)]] = mix(h)
    for i in order[len(h) :].tolist():
        out[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string array; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return text, offsets - (offsets[0] if len(offsets) else 0)


class Words:
    """The words of several texts: ``start``/``end`` byte places, ``hash``, and ``first``, the
    place of each text's first word (one entry more than texts)."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, fold: bool = True):
        self.text = _FOLD[text] if fold else text
        n = len(text)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[text]
        breaks = np.zeros(n + 1, bool)
        breaks[offsets[1:-1]] = True
        starts = inside[1:] & (~inside[:-1] | breaks)
        ends = inside[:-1] & (~inside[1:] | breaks)
        self.start, self.end = np.flatnonzero(starts[: n + 1]), np.flatnonzero(ends[: n + 1])
        self.first = np.searchsorted(self.start, offsets)

    @cached_property
    def hash(self) -> np.ndarray:
        return word_hashes(self.text, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.text[self.start[i] : self.end[i]].tobytes()

    def shingles(self, k: int) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's runs of ``k`` words; of the whole text if it has fewer."""
        h, out = self.hash, []
        whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            whole = mix(whole * _MUL + h[j : len(h) - k + 1 + j]) if len(whole) else whole
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                x = np.uint64(b - a)
                for w in h[a:b]:
                    x = mix(np.array([x], np.uint64) * _MUL + w)[0]
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


#: Marks that usually end a word.
MARKS = frozenset(".,;:!?")
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[ord(c) for c in MARKS]] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def marked(w: Words) -> np.ndarray:
    """Which words are a body and one mark after a letter (ASCII or Latin-1), which no tokenizer here joins."""
    long = w.end - w.start > 1
    before = w.text[np.maximum(w.end - 2, 0)]
    latin = np.zeros(len(long), bool)
    wide = np.flatnonzero(long & (before >= 0x80) & (w.end - w.start > 2))
    lead, trail = w.text[w.end[wide] - 3], before[wide]
    latin[wide] = (lead == 0xC3) & (trail != 0x97) & (trail != 0xB7)
    return long & _IS_MARK[w.text[w.end - 1]] & (_IS_LETTER[before] | latin)


def pieces(offsets: np.ndarray, most: int = 1 << 21):
    """Ranges of rows of at most ``most`` bytes (or one row)."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_batches(column, fold: bool = True):
    """(first row, end row, Words) over an Arrow string column, a few MB at a time."""
    text, offsets = string_bytes(column)
    for a, b in pieces(offsets):
        yield a, b, Words(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], fold)


class WordTable:
    """Ids of words by their hash, in flat arrays: what the same worker has encoded before is looked up for all
    words of a batch at once. The first distinct words are kept, which holds the frequent ones: ``most`` words
    and ``most_ids`` ids, about 20 MB. Words that find no room are encoded anew in every batch."""

    def __init__(self, dtype: str, most: int = 700_000, most_ids: int = 2_200_000):
        self.dtype, self.most, self.most_ids = dtype, most, most_ids
        self.keys, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, dtype)

    def places(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words: ids in a row, starts and sizes of each one's, and the distinct word of each word.
        ``make(at)`` gives the ids of the words at places ``at`` in a row, and the number of each one's."""
        unique, at, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
        new, flat = np.flatnonzero(~known), self.flat
        starts, sizes = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        starts[known], sizes[known] = self.starts[place[known]], self.sizes[place[known]]
        if len(new):
            made, n = make(at[new])
            sizes[new], starts[new] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, made])
            if len(self.keys) + len(new) <= self.most and len(flat) <= self.most_ids:
                where, self.flat = place[new], flat
                self.keys = np.insert(self.keys, where, unique[new])
                self.starts, self.sizes = np.insert(self.starts, where, starts[new]), np.insert(self.sizes, where, n)
        return flat, starts, sizes, back

    def encode(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of each word's."""
        flat, starts, sizes, back = self.places(keys, make)
        sizes = sizes[back]
        return flat[spread(starts[back], sizes)], sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
