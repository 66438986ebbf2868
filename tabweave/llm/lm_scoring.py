"""Language-model scoring: a causal self-attention model over subword ids, and a memory of passages.

A text is its words (lower-cased in A-Z, each with one blank before it) as ids of
a public byte-level BPE file, then one end. Each place attends to itself and to the
places before it in its window; from the last layer follow the probabilities of the
next id in two steps: of a root class (frequent ids are classes of their own), and of the
id within its class. Ids beyond the ``LEAVES`` most frequent ones share a last leaf
by their counts. Texts are scored in overlapping windows: each window gives scores for
the places that no earlier one has scored, with at least ``OVERLAP`` ids of context.

Texts that repeat passages of others are likelier than a small model can know. Words are
cut into segments where a hash of two words says so, the same in all copies. A segment's
probability is ``(1 - share) * P(attention) + share * c / N``: N counts the segments of all
training texts, c those equal to it (without itself, in a training text), and ``share``
is the share of segments that occur more than once.

What is learned, and from what:

* counts of words, ids and segments by grouped aggregation over all training texts;
* the attention weights from windows of all training texts that hold every id. Each task trains a replica on its windows, and
  the replicas' weights are averaged level by level, ``ROUNDS`` times.

The most frequent words and segments (``HEAD``) are broadcast; others are joined with their
counts by a shuffle. Nothing is dropped: all words, ids and segments of all texts are
counted and scored.

Null and empty texts have one token, the end. Rows that repeat are scored one by
one; rows with a null key are training texts; very long words are encoded whole. Without training
texts all ids are equally likely. Columns of the input other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tabweave.llm.common import Words, WordTable, bounded_batches, durable, freed, held, mix, pieces, spread, string_bytes
from tabweave.storage import unused, written

WINDOW, OVERLAP, WIDTH, INNER = 24, 3, 16, 32
#: Root classes of single ids, classes of several, and ids with a leaf of their own.
SINGLE, CLUSTERS, LEAVES = 32, 32, 4096
ROOT = SINGLE + CLUSTERS
#: Ids from one training window's beginning to the next; rounds, and Adam's windows a step and rate.
BLOCK, ROUNDS, BATCH, RATE = WINDOW, 3, 128, 0.02
#: Windows that a replica passes in a round (about 500 steps). Tables with fewer pass them
#: repeatedly; ones with enough for all rounds pass each window once.
REPLICA = 64_000
#: Words or segments that are broadcast, and words between two cuts on average.
HEAD, CUT = 1 << 18, 32
_WORDS, _SEGMENTS, _IDS, _TEXTS = 0, 1, 2, 3
_END = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 20


class Subwords:
    """Ids of words, by a table of those that the worker has seen."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.dtype = "<u2" if self.size < 1 << 16 else "<u4"
        self.names = {i: token for token, i in ranks.items()}
        self.leads = np.zeros(self.size, bool)
        self.leads[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.table = WordTable(self.dtype)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and the number of each one's."""
        texts = [w.decode() for w in words]
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(texts)), self.dtype)
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) == len(texts):
            return ids, np.diff(np.append(starts, len(ids)))
        if len(texts) == 1:
            return ids, np.array([len(ids)])
        (a, m), (b, n) = (self._encode(x) for x in (words[: len(words) // 2], words[len(words) // 2 :]))
        return np.concatenate([a, b]), np.concatenate([m, n])

    def make(self, w: Words):
        return lambda at: self._encode([w.word(i) for i in at.tolist()])


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


def word_pieces(column) -> Iterator[tuple[int, int, Words]]:
    text, offsets = string_bytes(column)
    for i, j in pieces(offsets, PIECE):
        yield i, j, Words(text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def segments(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' words and ends: the place of each segment's first one, the segments' hashes, and each text's first segment."""
    h = np.insert(w.hash, w.first[1:], _END)
    ends = w.first[1:] + np.arange(len(w.first) - 1)
    cut = np.zeros(len(h), bool)
    cut[1:] = mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(CUT) == 0
    first = w.first[:-1] + np.arange(len(w.first) - 1)
    cut[first] = False  # a text's first word has none before it
    cut[ends] = True
    starts = np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1])
    place = (np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))).astype(np.uint64)
    return starts, mix(np.add.reduceat(mix(h ^ mix(place * _STEP)), starts)), np.searchsorted(starts, np.append(first, len(h)))


# --- what is counted over all training texts ---------------------------------


def counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """kind, key, n: words and segments by hash, ids, and the number of texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s, texts = subwords(tokenizer), 0
        by_id = np.zeros(s.size + 1, np.int64)
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {_WORDS: [], _SEGMENTS: []}

        def rows(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        def merged(kind):
            keys, back = np.unique(np.concatenate([k for k, _ in kept[kind]]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n for _, n in kept[kind]])).astype(np.int64)
            kept[kind] = []
            return rows(kind, keys, n)

        for b in batches:
            for i, j, w in word_pieces(b.column(0)):
                flat, starts, sizes, back = s.table.places(w.hash, s.make(w))
                n = np.bincount(back, minlength=len(starts)).astype(np.int64)
                by_id[: s.size] += np.bincount(flat[spread(starts, sizes)], np.repeat(n, sizes), minlength=s.size).astype(np.int64)
                at = np.zeros(len(starts), np.int64)
                at[back] = np.arange(len(back))
                kept[_WORDS].append((w.hash[at], n))
                kept[_SEGMENTS].append(np.unique(segments(w)[1], return_counts=True))
                texts += j - i
            for kind in kept:
                if sum(len(k) for k, _ in kept[kind]) > 1_000_000:
                    yield merged(kind)
        yield from (merged(kind) for kind in kept if kept[kind])
        by_id[s.size] = texts
        at = np.flatnonzero(by_id)
        yield rows(_IDS, at, by_id[at])
        yield rows(_TEXTS, np.zeros(1, np.int64), np.array([texts], np.int64))

    return docs.mapInArrow(freed(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def training_windows(docs: DataFrame, tokenizer: str, one_in: int = 1) -> DataFrame:
    """``windows``: rows of WINDOW + 1 ids (the one before, or the end at a text's beginning; the largest number fills up), as bytes.

    A window begins at every ``BLOCK``-th id of a text, so that every id and end is the next one in one window.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = subwords(tokenizer)
        for b in batches:
            for _, _, w in word_pieces(b.column(0)):
                ids, sizes = s.table.encode(w.hash, s.make(w))
                n = np.diff(np.concatenate([[0], np.cumsum(sizes)])[w.first])
                # an end, the ids and an end, one text after the other
                first = np.cumsum(n + 2) - (n + 2)
                line = np.full(len(ids) + 2 * len(n), s.size, s.dtype)
                line[spread(first + 1, n)] = ids
                taken = -(-(n // BLOCK + 1) // one_in)
                start = BLOCK * one_in * spread(np.zeros(len(n), np.int64), taken)
                left = np.minimum(np.repeat(n + 2, taken) - start, WINDOW + 1)
                at = np.repeat(first, taken) + start
                out = line[np.minimum(at[:, None] + np.arange(WINDOW + 1), len(line) - 1)]
                out[np.arange(WINDOW + 1) >= left[:, None]] = np.iinfo(s.dtype).max
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.array_split(out, len(out) // 1024 + 1)], pa.binary())], names=["windows"])

    return docs.mapInArrow(freed(run), "windows binary")


# --- the model ---------------------------------------------------------------


@dataclass
class Layout:
    """The leaf of every id (the end last), the log of its share in the leaf, and the leaves' root classes and places in them."""

    leaf: np.ndarray
    log_share: np.ndarray
    root: np.ndarray
    inner: np.ndarray
    root_bias: np.ndarray
    inner_bias: np.ndarray

    @property
    def end(self) -> int:
        return int(self.leaf[-1])


def layout(by_id: np.ndarray, names: dict[int, bytes]) -> Layout:
    """Leaves of the most frequent ids; classes of several leaves are runs in the order of the ids' bytes."""
    n = by_id + 0.5 / len(by_id)
    order = np.lexsort((np.arange(len(n)), -n))
    own = order[: min(LEAVES, max(1, int((by_id > 0).sum())))]
    own = np.append(own[own != len(n) - 1], len(n) - 1)  # the end always has a leaf; rare ids share the one after the last
    leaf = np.full(len(n), len(own))
    leaf[own] = np.arange(len(own))
    weight = np.bincount(leaf, n, minlength=len(own) + 1)
    root, inner = np.zeros(len(own) + 1, np.int64), np.zeros(len(own) + 1, np.int64)
    by_weight = np.lexsort((np.arange(len(weight)), -weight))
    single, rest = by_weight[:SINGLE], by_weight[SINGLE:]
    root[single] = np.arange(len(single))
    rest = np.array(sorted(rest.tolist(), key=lambda x: (names.get(int(own[x]), b"") if x < len(own) else b"", x)), np.int64)
    for k, part in enumerate(np.array_split(rest, CLUSTERS)):
        root[part], inner[part] = SINGLE + k, np.arange(len(part))
    tiny = 1e-9 * weight.sum()
    roots = np.bincount(root, weight, minlength=ROOT)
    inside = np.full((CLUSTERS, max(1, -(-len(rest) // CLUSTERS))), -np.inf)
    several = root >= SINGLE
    inside[root[several] - SINGLE, inner[several]] = np.log(weight[several] / roots[root[several]])
    empty = ~np.isfinite(inside).any(1)
    inside[empty, 0] = 0
    return Layout(leaf, np.log(n / weight[leaf]).astype(np.float32), root, inner, np.log((roots + tiny) / (roots + tiny).sum()).astype(np.float32), np.maximum(inside, -60).astype(np.float32))


def initial(a: Layout, seed: int = 3) -> dict[str, np.ndarray]:
    """Random weights whose output is the leaves' shares alone."""
    rng, leaves = np.random.default_rng(seed), len(a.root)
    random = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": random(0.4, leaves, WIDTH), "shift": random(0.2, leaves, WIDTH), "place": random(0.1, WINDOW, WIDTH), "attend": random(WIDTH**-0.5, WIDTH, 3 * WIDTH),
        "up": random(WIDTH**-0.5, WIDTH, INNER), "bias": np.zeros(INNER, np.float32), "down": random(0.5 * INNER**-0.5, INNER, WIDTH),
        "root": np.zeros((WIDTH, ROOT), np.float32), "root_bias": a.root_bias.copy(), "inner": np.zeros((CLUSTERS, WIDTH, a.inner_bias.shape[1]), np.float32), "inner_bias": a.inner_bias.copy(),
    }


def flattened(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflattened(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: x.reshape(like[k].shape).astype(np.float32, copy=False) for k, x in zip(sorted(like), np.split(flat, cuts), strict=True)}


_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SCALE = np.float32(WIDTH**-0.5)
_ONES = np.ones(WINDOW, np.float32)


def _shifted(u: np.ndarray, end: int) -> np.ndarray:
    out = np.full_like(u, end)
    out[:, 1:] = u[:, :-1]
    return out


def _exp(z: np.ndarray, most: float = 80) -> None:
    """Exponentials in place, of numbers up to ``most`` either way."""
    if max(z.max(initial=0), -z.min(initial=0)) > most:
        np.clip(z, -most, most, out=z)
    np.exp(z, out=z)


def hidden(w: dict[str, np.ndarray], u: np.ndarray, end: int) -> tuple[np.ndarray, tuple]:
    """Last layer of windows ``u`` (windows x places) of leaves, with a one after it; each place attends to itself and those before."""
    x = np.take(w["embed"], u, 0)
    x += np.take(w["shift"], _shifted(u, end), 0)
    x += w["place"]
    x = x.reshape(-1, WIDTH)
    qkv = (x @ w["attend"]).reshape(*u.shape, 3 * WIDTH)
    q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    q *= _SCALE
    a = q @ k.transpose(0, 2, 1)
    _exp(a, 30)
    a *= _MASK
    scale = 1 / (a @ _ONES).reshape(-1, 1)
    seen = (a @ v).reshape(-1, WIDTH)
    seen *= scale
    h = x + seen
    m = h @ w["up"]
    m += w["bias"]
    np.maximum(m, 0, out=m)
    g = np.ones((len(x), WIDTH + 1), x.dtype)
    np.matmul(m, w["down"], out=g[:, :WIDTH])
    g[:, :WIDTH] += h
    return g, (x, q, k, v, a, scale, seen, h, m)


def _by_class(root: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rows of each class of several leaves among those of the targets."""
    rows = np.flatnonzero(root >= SINGLE)
    kind = root[rows] - SINGLE
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    sizes = np.bincount(kind, minlength=CLUSTERS)
    return [(c, part) for c, part in enumerate(np.split(rows[order], np.cumsum(sizes)[:-1])) if len(part)]


@dataclass
class Ready:
    """Weights as scoring uses them: the scale within the queries, the biases as a last row."""

    w: dict[str, np.ndarray]
    attend: np.ndarray
    root: np.ndarray
    inner: np.ndarray

    @classmethod
    def of(cls, w: dict[str, np.ndarray]) -> Ready:
        attend = w["attend"].copy()
        attend[:, :WIDTH] *= _SCALE
        return cls(w, attend, np.concatenate([w["root"], w["root_bias"][None]]), np.concatenate([w["inner"], w["inner_bias"][:, None]], 1))

    def last(self, u: np.ndarray, end: int) -> np.ndarray:
        """``hidden``'s last layer with a one after it."""
        w = self.w
        x = np.take(w["embed"], u, 0)
        x += np.take(w["shift"], _shifted(u, end), 0)
        x += w["place"]
        qkv = (x.reshape(-1, WIDTH) @ self.attend).reshape(*u.shape, 3 * WIDTH)
        q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1), qkv[..., 2 * WIDTH :]
        a = q @ k
        _exp(a, 30)
        a *= _MASK
        got = a @ v
        got /= (a @ _ONES)[..., None]
        x += got
        x = x.reshape(-1, WIDTH)
        m = x @ w["up"]
        m += w["bias"]
        np.maximum(m, 0, out=m)
        out = np.ones((len(x), WIDTH + 1), x.dtype)
        np.matmul(m, w["down"], out=out[:, :WIDTH])
        out[:, :WIDTH] += x
        return out


def _logs(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the shares at places ``at`` of the rows' exponentials; overwrites ``z``."""
    _exp(z)
    return np.log(z[np.arange(len(z)), at] / (z @ np.ones(z.shape[1], z.dtype)))


def log_probabilities(ready: Ready, a: Layout, u: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """Of the leaves at the scored places, in order."""
    out, step = [], 8 * BATCH
    for i in range(0, len(u), step):
        on = np.flatnonzero(scored[i : i + step])
        target = targets[i : i + step].ravel()[on]
        g, root = ready.last(u[i : i + step], a.end).take(on, 0), a.root[target]
        got = _logs(g @ ready.root, root)
        parts = _by_class(root)
        if parts:
            rows = np.concatenate([part for _, part in parts])
            sorted_, z, at = g[rows], np.empty((len(rows), ready.inner.shape[2]), g.dtype), 0
            for c, part in parts:
                np.matmul(sorted_[at : at + len(part)], ready.inner[c], out=z[at : at + len(part)])
                at += len(part)
            got[rows] += _logs(z, a.inner[target[rows]])
        out.append(got)
    return np.concatenate(out)


def gradients(w: dict[str, np.ndarray], a: Layout, u: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the scored places."""
    ready = Ready.of(w)
    g, (x, q, k, v, e, scale, seen, h, m) = hidden(w, u, a.end)
    n, deep = u.size, lambda t: t.reshape(*u.shape, WIDTH)
    target, on = targets.ravel(), scored.ravel()
    root, part = a.root[target], on * x.dtype.type(1 / max(1, scored.sum()))

    def pulled(z, at, part):
        """From the numbers before a softmax to their gradients, in place."""
        _exp(z)
        z *= (part / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
        z[np.arange(len(z)), at] -= part

    pulled(z := g @ ready.root, root, part)
    by_root, dg = g.T @ z, z @ w["root"].T
    by_inner, parts = np.zeros_like(ready.inner), _by_class(np.where(on, root, 0))
    if parts:
        rows = np.concatenate([rows for _, rows in parts])
        cuts = np.cumsum([0] + [len(rows) for _, rows in parts])
        near, z, back = g[rows], np.empty((len(rows), ready.inner.shape[2]), g.dtype), np.empty((len(rows), WIDTH), g.dtype)
        runs = [(c, slice(i, j)) for (c, _), i, j in zip(parts, cuts[:-1], cuts[1:], strict=True)]
        for c, run in runs:
            np.matmul(near[run], ready.inner[c], out=z[run])
        pulled(z, a.inner[target[rows]], part[rows])
        for c, run in runs:
            by_inner[c] = near[run].T @ z[run]
            np.matmul(z[run], w["inner"][c].T, out=back[run])
        dg[rows] += back
    dm = dg @ w["down"].T
    dm *= m > 0
    out = {"root": by_root[:-1], "root_bias": by_root[-1], "inner": by_inner[:, :-1], "inner_bias": by_inner[:, -1], "down": m.T @ dg, "up": h.T @ dm, "bias": np.ones(n, x.dtype) @ dm}
    dh = dm @ w["up"].T
    dh += dg
    # e holds the exponentials, whose rows' sums are 1 / scale
    scaled = dh * scale
    ds = deep(scaled) @ v.transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", scaled, seen).reshape(*u.shape, 1)
    ds *= e
    dqkv = np.empty((*u.shape, 3 * WIDTH), x.dtype)
    np.matmul(ds, k, out=dqkv[..., :WIDTH])
    dqkv[..., :WIDTH] *= _SCALE
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., WIDTH : 2 * WIDTH])
    np.matmul(e.transpose(0, 2, 1), deep(scaled), out=dqkv[..., 2 * WIDTH :])
    dqkv = dqkv.reshape(n, 3 * WIDTH)
    dx = dqkv @ w["attend"].T
    dx += dh
    dx = deep(dx)
    # a leaf is embedded at its own place and, shifted, at the next one
    both = np.zeros((*u.shape, 2 * WIDTH), x.dtype)
    both[..., :WIDTH] = dx
    both[:, :-1, WIDTH:] = dx[:, 1:]
    sums = _summed(u.ravel(), both.reshape(n, 2 * WIDTH), len(w["embed"]))
    sums[a.end, WIDTH:] += dx[:, 0].sum(0)
    return out | {"attend": x.T @ dqkv, "place": dx.sum(0), "embed": sums[:, :WIDTH], "shift": sums[:, WIDTH:]}


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each place."""
    out, width = np.zeros(n * rows.shape[1], rows.dtype), rows.shape[1]
    np.add.at(out, (at[:, None] * width + np.arange(width)).ravel(), rows.ravel())
    return out.reshape(n, width)


def descend(w: dict[str, np.ndarray], a: Layout, u: np.ndarray, targets: np.ndarray, scored: np.ndarray, rng: np.random.Generator, state: dict, begun: int = 0, steps: int = 2000) -> None:
    """One pass of Adam over the windows, in random order; changes ``w``. ``begun``: steps of earlier rounds, of ``steps`` in all."""
    order = rng.permutation(len(u))
    flat = flattened(w)
    w |= unflattened(flat, w)  # views
    if not state:
        state |= {"t": 0, "one": np.zeros_like(flat), "two": np.zeros_like(flat)}
    one, two = state["one"], state["two"]
    for i in range(0, len(u), BATCH):
        at = order[i : i + BATCH]
        g = flattened(gradients(w, a, u[at], targets[at], scored[at]))
        t = state["t"] = state["t"] + 1
        rate = RATE * max(0.05, 1 - (begun + t) / steps) / (1 - 0.9**t)
        one *= 0.9
        one += np.float32(0.1) * g
        g *= g
        g *= 0.01
        two *= 0.99
        two += g
        np.sqrt(two, out=g)
        g *= (1 - 0.99**t) ** -0.5
        g += 1e-7
        np.divide(one, g, out=g)
        g *= rate
        flat -= g


def windows(c: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of all windows over texts of leaves ``c``, and which places each one scores: every place of every text once."""
    step, sizes = WINDOW - OVERLAP, np.diff(first)
    n = np.maximum(1, -(-(sizes - OVERLAP) // step))
    nth = spread(np.zeros(len(n), np.int64), n)
    at = (np.repeat(first[:-1], n) + nth * step)[:, None] + np.arange(WINDOW)
    inside = at < np.repeat(first[1:], n)[:, None]
    scored = inside & ((np.arange(WINDOW) >= OVERLAP) | (nth == 0)[:, None])
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[first[:-1]] = end
    at = np.minimum(at, len(c) - 1)
    return np.where(inside, before[at], end), c[at], scored


@dataclass
class Model:
    layout: Layout
    weights: dict[str, np.ndarray]

    def log_of_ids(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of all ids of texts (each with its end), given those before."""
        out, ready = np.empty(len(ids), np.float64), Ready.of(self.weights)
        c = self.layout.leaf[ids]
        step = 1 << 16  # texts are scored together up to so many ids
        cuts, at = [0], 0
        while at < len(first) - 1:
            at = max(at + 1, int(np.searchsorted(first, first[at] + step, "right")) - 1)
            cuts.append(at)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            out[first[i] : first[j]] = log_probabilities(ready, self.layout, *windows(c[first[i] : first[j]], first[i : j + 1] - first[i], self.layout.end))
        return out + self.layout.log_share[ids]


def _averaged(vectors: DataFrame, parts: int) -> np.ndarray | None:
    """Sum of the vectors (slot below ``parts``, vector of doubles as bytes), 32 at a time."""

    def add(table):
        import pyarrow as pa

        total = 0.0
        for x in table.column("vector"):
            total = total + np.frombuffer(x.as_py(), np.float64)
        return pa.table({"slot": table.column("slot").slice(0, 1), "vector": pa.array([total.tobytes()], pa.binary())})

    while parts > 1:
        vectors, parts = vectors.withColumn("slot", F.expr("slot div 32").cast("int")).groupBy("slot").applyInArrow(add, "slot int, vector binary"), -(-parts // 32)
    got = vectors.collect()  # one vector
    return np.frombuffer(got[0].vector, np.float64) if got else None


def fit(training: DataFrame, by_id: np.ndarray, tokenizer: str, rounds: int = ROUNDS) -> Model:
    """Learns weights from all windows of the texts of ``training`` (one column).

    There are as many replicas as give each ``REPLICA`` windows a round, so that more texts mean more tasks, not longer ones.
    """
    spark, s = training.sparkSession, subwords(tokenizer)
    a = layout(by_id, s.names)
    start = initial(a)
    chosen = written(training_windows(training, tokenizer))
    row = np.dtype(s.dtype).itemsize * (WINDOW + 1)
    total = (chosen.agg(F.sum(F.octet_length("windows"))).first()[0] or 0) // row
    passes = min(40, -(-REPLICA // max(1, total)))
    shares = rounds if total >= rounds * REPLICA else 1
    parts = max(1, round(passes * total / shares / REPLICA))
    begun, steps = 0, max(1, rounds * passes * total // shares // parts // BATCH)
    for k in range(rounds if total else 0):
        shared = spark.sparkContext.broadcast((a, start, begun))

        def train(batches: Iterator, shared=shared, k=k) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            held()
            a, start, begun = shared.value
            w, rng, state, n = {k: x.copy() for k, x in start.items()}, np.random.default_rng(k), {}, 0
            kept: list[np.ndarray] = []

            def learn():
                nonlocal n
                raw = np.concatenate(kept)
                kept.clear()
                blank = raw == np.iinfo(raw.dtype).max
                c = a.leaf[np.where(blank, len(a.leaf) - 1, raw)]
                for _ in range(passes):
                    descend(w, a, c[:, :-1], c[:, 1:], ~blank[:, 1:], rng, state, begun, steps)
                n += len(raw)

            for b in batches:
                kept.extend(np.frombuffer(x, s_dtype).reshape(-1, WINDOW + 1) for x in b.column(0).to_pylist() if x)
                if sum(map(len, kept)) > 40_000:
                    learn()
            if kept:
                learn()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([(np.append(flattened(w).astype(float), 1.0) * n).tobytes()], pa.binary())], names=["slot", "vector"])

        s_dtype = s.dtype
        dealt = chosen.filter(F.pmod(F.xxhash64("windows"), F.lit(shares)) == k % shares).repartition(parts)
        got = _averaged(dealt.mapInArrow(freed(train), "slot int, vector binary"), parts)
        if got is not None:
            start = unflattened(got[:-1] / got[-1], start)
        begun += passes * total // shares // parts // BATCH
    unused(spark, chosen)
    return Model(a, start)


def _head(counted: DataFrame, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the most frequent keys (of a count of ``least`` or more), at most ``most``: those above a count that a histogram gives."""
    level = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int")
    counted = counted.filter(F.col("n") >= least)
    sizes = sorted(((r.level, r.asDict()["keys"]) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("keys")).collect()), reverse=True)
    lowest, total = None, 0
    for x, k in sizes:
        total += k
        if total > most:
            break
        lowest = x
    rows = counted.filter(level >= lowest).select("key", "n").toPandas() if lowest is not None else None
    keys = np.zeros(0, np.uint64) if rows is None else rows["key"].to_numpy(np.int64).view(np.uint64)
    n = np.zeros(0, np.int64) if rows is None else rows["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _look_up(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the head, and their counts (0 for others)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, n[at], 0)


def score(df: DataFrame, held_out: Column, tokenizer: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score, attention_score (without the memory of passages) and score, one row per row; learns from rows not held out."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(key).alias("_tw_key"), F.col(text).alias("_tw_text"), F.coalesce(held_out, F.lit(False)).alias("_tw_out"))
    training = docs.filter(~F.col("_tw_out"))
    counted = durable(counts(training.select("_tw_text"), tokenizer))
    words, passages = (counted.filter(F.col("kind") == kind).select("key", "n") for kind in (_WORDS, _SEGMENTS))
    sums = {r["kind"]: r for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("again")).collect()}
    texts = sums[_TEXTS].n if _TEXTS in sums else 0
    n, kinds = (sums[_WORDS].n, sums[_WORDS].kinds) if _WORDS in sums else (0, 0)
    n, kinds = n + texts, kinds + (texts > 0)
    passed = sums[_SEGMENTS].n if _SEGMENTS in sums else 0
    share = min(0.5, max(1e-3, (sums[_SEGMENTS].again or 0) / passed)) if passed else 0.0
    by_id = np.zeros(subwords(tokenizer).size + 1)
    for r in counted.filter(F.col("kind") == _IDS).select("key", "n").toLocalIterator():  # at most one row an id
        by_id[r.key] = r.n
    model = fit(training.select("_tw_text"), by_id, tokenizer)
    shared = spark.sparkContext.broadcast((model, _head(words, head), _head(passages, head, 2)))
    novel, known_share = float(np.log1p(-share)), share / max(1, passed)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held()
        (model, word_head, passage_head), s = shared.value, subwords(tokenizer)
        end = np.array([s.size], np.int64)
        for b in batches:
            for i, j, w in word_pieces(b.column(1)):
                flat, starts, sizes, back = s.table.places(w.hash, s.make(w))
                # words and ends, their ids, and where each text's begin
                first = w.first + np.arange(len(w.first))
                size = np.insert(sizes[back], w.first[1:], 1)
                ids = np.concatenate([flat.astype(np.int64), end])[spread(np.insert(starts[back], w.first[1:], len(flat)), size)]
                at = np.concatenate([[0], np.cumsum(size)])
                logs = model.log_of_ids(ids, at[first])
                seg, name, seg_first = segments(w)
                of_seg = np.add.reduceat(logs, at[seg])
                plain = np.add.reduceat(of_seg, seg_first[:-1])
                own = np.repeat(~b.column(2)[i:j].to_numpy(zero_copy_only=False), np.diff(seg_first)).astype(np.int64)
                in_head, c = _look_up(*passage_head, name)
                c = np.maximum(c - own, 0)
                mixed = np.where(c > 0, np.logaddexp(novel + of_seg, np.log(np.maximum(c, 1) * known_share + 1e-300)), novel + of_seg)
                rare = ~in_head
                rare_at = np.concatenate([[0], np.cumsum(rare)])[seg_first].astype(np.int32)
                segs = pa.ListArray.from_arrays(pa.array(rare_at), pa.StructArray.from_arrays([pa.array(name[rare].view(np.int64)), pa.array(of_seg[rare])], names=["key", "log"]))
                # the base score's words
                at_one = np.zeros(len(starts), np.int64)
                at_one[back] = np.arange(len(back))
                hit, count = _look_up(*word_head, w.hash[at_one])
                base = np.concatenate([[0.0], np.cumsum(np.where(hit, np.log10(count + 1.0), 0.0)[back])])[w.first]
                known = np.concatenate([[0], np.cumsum(hit[back])])[w.first]
                tail = pa.ListArray.from_arrays(pa.array((w.first - known).astype(np.int32)), pa.array(w.hash[~hit[back]].view(np.int64)))
                scores = np.add.reduceat(mixed, seg_first[:-1]) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(2)[i:j], pa.array(np.diff(w.first) + 1), pa.array(np.diff(known).astype(np.int64)), pa.array(np.diff(base)), pa.array(plain / np.log(10)), pa.array(scores), tail, segs],
                    names=["_tw_key", "_tw_out", "n_tokens", "known", "base", "plain", "score", "tail", "segments"],
                )

    schema = StructType([docs.schema["_tw_key"], StructField("_tw_out", docs.schema["_tw_out"].dataType)]).add("n_tokens", "long").add("known", "long").add("base", "double").add("plain", "double").add("score", "double")
    schema = schema.add("tail", ArrayType(LongType())).add("segments", ArrayType(StructType().add("key", "long").add("log", "double")))
    scored = durable(docs.mapInArrow(freed(run), schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    by_row = rare.join(words, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rest"))
    others = F.col("n") - F.when(F.col("_tw_out"), 0).otherwise(1)
    # what a passage seen elsewhere adds to the log of its mixture
    plain = F.col("log") + novel
    gain = F.log1p(F.exp(F.log(others * known_share) - plain))
    gain = F.when(F.log(others * known_share) - plain > 700, F.log(others * known_share) - plain).otherwise(gain)
    by_passage = scored.select("row", "_tw_out", F.inline("segments")).join(passages, "key").filter(others > 0).groupBy("row").agg((F.sum(gain) / F.log(F.lit(10.0))).alias("of_passages"))
    out = scored.drop("tail", "segments").join(by_row, "row", "left").join(by_passage, "row", "left")
    lg = float(np.log10(n + kinds + 1.0))
    end, seen = float(np.log10(texts + 1.0)), int(texts > 0)
    return out.select(
        F.col("_tw_key").alias(key), F.col("_tw_out").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + seen).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + end - F.col("n_tokens") * lg).alias("base_score"), F.col("plain").alias("attention_score"), (F.col("score") + F.coalesce("of_passages", F.lit(0.0))).alias("score"),
    )
