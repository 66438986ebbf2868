"""N-gram Jaccard join with count vectors in R-trees, and its components.

A text's set holds the distinct runs of ``words`` words (the whole sequence if it
has fewer). Two texts link when ``den * |A and B| >= num * |A or B|``.

1. Texts of equal sets form a class, represented by its smallest id.
2. Tokens are hashed into groups, whose number K depends on the band of the set's
   size. Linked sets differ in at most ``d`` tokens, so with more than ``d``
   groups that hold tokens some group has equal tokens in both: sets that
   share such a group are candidates. Frequent tokens are left out of groups where
   enough groups stay filled, and sets with too few filled groups also share one
   of their ``d + 1`` smallest tokens. No candidate is missed.
3. Within candidates, the counts of tokens per group are points of an R-tree. The
   overlap of a set with all sets of a node is at most the sum of the smaller
   coordinates of its point and of the node's upper corner; nodes and points
   whose bound is too small are skipped. Pairs that earlier links already connect need
   no check. Large candidate sets are cut by set size into bands, these into blocks of
   bounded size, and pairs of blocks of the same or neighbouring bands are tasks of their own.
4. Candidates shrink to the sets that surviving pairs connect. Only these are sent whole, and
   within them pairs that the R-tree leaves are verified exactly. Links give components by
   label propagation.

All pairs that survive are verified on 64-bit token hashes. Texts are read whole.
Texts without words (null, empty) have an empty set and link with nothing. Rows
that repeat an id with the same text are one document; rows with an id but
different texts are judged each by its own text; rows with a null id form
no links and get a null component. Other columns are not read; an empty table gives no rows. No cap is set on groups, partners or
candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tabweave.llm.common import bounded_batches, durable, freed, mix, partitions, regrouped, small_or_not, word_batches
from tabweave.llm.components import connected_components

LEAST_GROUPS, LEAF = 16, 16
#: Tokens that a block may hold as sets or as points; a larger candidate set is cut into blocks.
BLOCK_TOKENS, BLOCK_POINTS = 600_000, 3_000_000
COUNT = np.dtype("<u2")
_SALT = np.uint64(0xD6E8FEB86659FD93)
ONE_IN, SEEN, MOST_COMMON = 16, 2, 1_000_000


class Plan:
    """Bands of set sizes and their numbers of groups."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differing(self, x: int, y: int) -> int:
        """Most tokens in which linked sets of these sizes can differ."""
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def overlap(self, x, y):
        """Least overlap of linked sets of these sizes."""
        return -((-self.num * (x + y)) // (self.den + self.num))

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(band, groups, largest difference) for each band in which a set of this size looks for partners."""
        out, at, edge = [], 0, 1
        while self.num * edge <= self.den * size:
            following = max(edge + 1, edge * 3 // 2)
            if following > size:
                most = self.differing(following - 1, following - 1)
                partner = min(self.den * size // self.num, following - 1)
                out.append((at, most + 1 + (most + 1) // 7 + 3 * (most > 0), self.differing(size, max(size, partner)) if size >= edge else self.differing(size, partner)))
            at, edge = at + 1, following
        return out


def _grouped(tokens: np.ndarray, groups: int, tag: np.uint64) -> np.ndarray:
    """A hash of each group that holds tokens."""
    h = mix(tokens ^ tag)
    group = ((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    order = np.argsort(group)
    group = group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return mix(np.add.reduceat(h[order], first) + mix(group[first] + tag))


def signatures(tokens: np.ndarray, plan: Plan, memo: dict, common: np.ndarray) -> np.ndarray:
    """Hashes of the set's groups, such that linked sets share at least one.

    ``common`` (sorted) holds frequent tokens. They are left out of the groups, since
    linked sets differ no more without them; a set with too few filled groups left
    also sends the groups of all its tokens, and if those are too few, its
    smallest tokens.
    """
    size = len(tokens)
    if size not in memo:
        if len(memo) > 20_000:
            memo.clear()
        memo[size] = plan.bands(size)
    rare = tokens[common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens] if len(common) else tokens
    out = []
    for band, groups, most in memo[size]:
        tag = np.uint64((band + 1) * int(_SALT) % 2**64)
        if len(common):
            found = _grouped(rare, groups, tag) if len(rare) else rare
            out.append(found)
            if len(found) > most:
                continue
        found = _grouped(tokens, groups, ~tag)
        out.append(found)
        if len(found) <= most:
            out.append(mix(np.sort(mix(tokens ^ tag))[: most + 1] + ~tag))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hash(tokens: np.ndarray) -> np.uint64:
    """The set's own hash, its node in the graph."""
    return np.add.reduce(mix(tokens)) if len(tokens) else np.uint64(0)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, n, node and a second hash of each whole set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i, j, w in word_batches(b.column(1)):
                sets = w.shingles(words)
                nodes = np.array([_hash(x) for x in sets], np.uint64).view(np.int64)
                check = np.array([np.bitwise_xor.reduce(mix(mix(x) + _SALT)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(nodes), pa.array(check)], names=["id", "n", "node", "check"])

    return docs.mapInArrow(freed(run), "id long, n long, node long, check long")


def common_tokens(docs: DataFrame, classes: DataFrame, words: int) -> np.ndarray:
    """Tokens of at least ``SEEN`` different sets of a sample of one in ``ONE_IN``, the most frequent ``MOST_COMMON``.

    They only steer which groups are compared; results are the same for any choice.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for _, _, w in word_batches(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*w.shingles(words), np.zeros(0, np.uint64)]).view(np.int64))], names=["token"])

    chosen = F.pmod(F.xxhash64("id"), F.lit(ONE_IN)) == 0
    sample = docs.filter(chosen).join(small_or_not(classes.select(F.col("rep").alias("id")).filter(chosen)), "id", "left_semi").select("_tw_text")
    counts = durable(sample.mapInArrow(freed(run), "token long").groupBy("token").count().filter(F.col("count") >= SEEN))
    return most_frequent(counts, MOST_COMMON)


def most_frequent(counts: DataFrame, most: int) -> np.ndarray:
    """Sorted tokens of the highest counts (rows: token, count), about ``most`` at most; of the lowest of these counts a share, by hash.

    The count where they end follows from the numbers of tokens by count, so that no order of all tokens is needed: sorting with a limit would
    send each task's first ``most`` rows to the driver. Tasks pack their tokens as bytes.
    """

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept = [b.column(0).to_numpy() for b in batches]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(kept).tobytes()], pa.binary())], names=["tokens"])

    # counts have few different values up to a bound, and few tokens exceed it
    level = F.least(F.col("count"), F.lit(1 << 16))
    least, share, total = 0, 1.0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect(), reverse=True):
        if total + r.tokens > most:
            least, share = r.level, (most - total) / r.tokens
            break
        total += r.tokens
    drawn = F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < int(share * (1 << 30))
    taken = counts.filter((level > least) | ((level == least) & drawn)).select("token")
    return np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.tokens, np.int64) for r in taken.mapInArrow(freed(pack), "tokens binary").collect())]).view(np.uint64))


def _candidates(docs: DataFrame, classes: DataFrame, words: int, plan: Plan) -> DataFrame:
    """a, b: edges that connect the nodes which share a signature.

    Copies within a task send their signatures once. Rows are sorted by signature
    within partitions and read as a stream, so that a common one needs no memory.
    """

    shared = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, classes, words))

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo: dict = {}
        sent: set[int] = set()
        for b in batches:
            for _, _, w in word_batches(b.column(0)):
                found, nodes = [], []
                for tokens in w.shingles(words):
                    node = int(_hash(tokens))
                    if len(tokens) and node not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(node)
                        found.append(signatures(tokens, plan, memo, shared.value))
                        nodes.append(node)
                if found:
                    owner = np.repeat(np.array(nodes, np.uint64).view(np.int64), [len(x) for x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(owner)], names=["s", "node"])

    def connect(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, first = None, 0
        for b in regrouped(batches, 8192):
            s, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
            firsts = node[starts]
            if len(s) and last is not None and s[0] == last:
                firsts[0] = first
            root = np.repeat(firsts, np.diff(np.append(starts, len(s))))
            if len(s):
                last, first = s[-1], root[-1]
            pairs = np.unique(np.stack([node, root])[:, node != root], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    signed = docs.select("_tw_text").mapInArrow(freed(sign), "s long, node long").repartition(partitions(docs.sparkSession), "s").sortWithinPartitions("s")
    # copies share most signatures, which are dealt to many tasks: each edge is kept once
    return durable(signed.mapInArrow(freed(connect), "a long, b long").distinct())


def point(tokens: np.ndarray, groups: int | None = None) -> np.ndarray:
    """Counts of a set's tokens per group. The number of groups, a power of two, leaves four to eight tokens a group in larger sets."""
    groups = groups or max(LEAST_GROUPS, 1 << max(0, len(tokens).bit_length() - 3))
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The point over fewer groups."""
    return counts.reshape(-1, groups).sum(0)


class Tree:
    """An R-tree: points, tiled by size and by the sum of every other coordinate into leaves, with the upper corner and least size of each leaf."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slices = max(1, math.isqrt(-(-len(sizes) // LEAF)))
        by_size = np.argsort(sizes, kind="stable")
        half = points[:, ::2].sum(1)
        self.order = np.concatenate([x[np.argsort(half[x], kind="stable")] for x in np.array_split(by_size, slices)])
        self.points, self.sizes = points[self.order], sizes[self.order]
        cuts = np.arange(0, len(sizes), LEAF)
        self.upper, self.least = np.maximum.reduceat(self.points, cuts, axis=0), np.minimum.reduceat(self.sizes, cuts)

    def near(self, q: int, open_: np.ndarray, plan: Plan) -> np.ndarray:
        """Places among ``open_`` whose overlap bound with the point at place q reaches what a link needs."""
        p, size = self.points[q], int(self.sizes[q])
        leaves = np.unique(open_ // LEAF)
        leaves = leaves[np.minimum(self.upper[leaves], p).sum(1) >= plan.overlap(size, self.least[leaves])]
        at = open_[np.isin(open_ // LEAF, leaves)] if len(leaves) else open_[:0]
        return at[np.minimum(self.points[at], p).sum(1) >= plan.overlap(size, self.sizes[at])]


def link(points: list[np.ndarray], side: np.ndarray, plan: Plan, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets; with two sides, of pairs across only. Without the sets, links of all pairs
    that their points don't rule out."""
    least = min(map(len, points))
    counts = np.stack([folded(p, least) for p in points]).astype(np.int32)
    tree = Tree(counts, counts.sum(1))
    side, n, out = side[tree.order], len(points), []
    across, label, places = side.any() and not side.all(), np.arange(n), np.arange(n)
    for q in range(n - 1):
        open_ = places[q + 1 :][label[q + 1 :] != label[q]]
        # linked sets differ in size by a bounded factor
        open_ = open_[(plan.num * tree.sizes[open_] <= plan.den * tree.sizes[q]) & (plan.num * tree.sizes[q] <= plan.den * tree.sizes[open_])]
        if across:
            open_ = open_[side[open_] != side[q]]
        for p in tree.near(q, open_, plan).tolist() if len(open_) else ():
            if label[p] == label[q]:
                continue
            i, j = int(tree.order[q]), int(tree.order[p])
            if sets is not None:
                a, b = sets[i], sets[j]
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                if plan.den * both < plan.num * (len(a) + len(b) - both):
                    continue
            label[label == label[p]] = label[q]
            out.append((i, j))
    return out


def _sent(tokens: np.ndarray, exact: bool) -> bytes:
    return tokens.tobytes() if exact else point(tokens).astype(COUNT).tobytes()


def _links(members: DataFrame, docs: DataFrame, words: int, plan: Plan, exact: bool) -> DataFrame:
    """a, b: links that connect the linked sets of each candidate set; members: id, node, n, component.

    If not ``exact``, points are sent in place of sets (a byte for four to eight tokens of eight bytes each), and links are
    those that the points' bounds leave.
    """
    block_tokens = BLOCK_TOKENS if exact else BLOCK_POINTS
    sizes = members.groupBy("component").agg(F.sum("n").alias("tokens"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bins = total // block_tokens + 1
    # bands of sizes a little wider than linked sets can differ, so that links stay within a band or join neighbours
    width = math.log(max(plan.den / plan.num, 1.001)) * (1 + 1e-6)
    large = sizes.withColumn("large", F.col("tokens") > block_tokens).select("component", "large")
    banded = durable(members.join(large, "component").withColumn("band", F.when(F.col("large") | F.lit(not exact), F.floor(F.log("n") / width)).otherwise(0).cast("long")))
    order = Window.partitionBy("component").orderBy("band")
    blocks = banded.groupBy("component", "band").agg(F.ceil(F.sum("n") / block_tokens).cast("long").alias("blocks"))
    beside = lambda f, d: F.coalesce(F.when(f("band").over(order) == F.col("band") + d, f("blocks").over(order)), F.lit(0))
    blocks = blocks.withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)})  # a component has few bands
    placed = banded.join(blocks, ["component", "band"]).select("id", "node", "component", "large", "band", "blocks", "below", "above")
    rows = docs.join(small_or_not(durable(placed)), "id").select("component", "node", "large", "band", "blocks", "below", "above", "_tw_text")
    kept = "component long, node long, large boolean, band long, blocks long, below long, above long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i, j, w in word_batches(b.column(7)):
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(7)), pa.array([_sent(s, exact) for s in w.shingles(words)], pa.binary())], names=[*b.schema.names[:7], "tokens"])

    sets = rows.mapInArrow(freed(run), f"{kept}, tokens binary").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # a set meets all blocks of its own band and of the neighbouring ones; (band, i, j, across) names the pair of blocks
    meets = """concat(
        transform(sequence(0L, blocks - 1), t -> struct(band, least(own, t) AS i, greatest(own, t) AS j, false AS across, own <= t AS side)),
        transform(filter(sequence(0L, greatest(above, 1L) - 1), t -> t < above), t -> struct(band, own AS i, t AS j, true AS across, true AS side)),
        transform(filter(sequence(0L, greatest(below, 1L) - 1), t -> t < below), t -> struct(band - 1 AS band, t AS i, own AS j, true AS across, false AS side)))"""
    sets = sets.withColumn("pair", F.explode(F.expr(meets)))
    # small candidate sets share a task; each pair of blocks of a large one is a task
    sets = sets.withColumn("task", F.when(F.col("large"), F.xxhash64("component", "pair.band", "pair.i", "pair.j", "pair.across")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins))))

    def solve(table):
        import pyarrow as pa

        keys = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("across", "j", "i", "band", "component")])
        ids, side, tokens = table.column("node").to_numpy(), table.column("side").to_numpy(zero_copy_only=False), table.column("tokens").to_pylist()
        order = np.lexsort((ids, *keys))
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(keys[:, order], axis=1) != 0).any(0), [True]])) if len(order) else []
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[s:e]
            got = [np.frombuffer(tokens[x], np.uint64 if exact else COUNT) for x in at]
            least = min(len(point(x)) for x in got) if exact else 0
            for x, y in link([point(x, least) for x in got], side[at], plan, got) if exact else link(got, side[at], plan):
                a.append(ids[at[x]])
                b.append(ids[at[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # written, so that no stage has two Python workers a task
    return durable(sets.select("task", "component", "pair.*", "node", "tokens").groupBy("task").applyInArrow(solve, "a long, b long"))


def components(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``key``, n_shingles and component_id, the smallest key reachable by links."""
    bounded_batches(df.sparkSession)
    plan = Plan(num, den)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_tw_text"))
    slim = durable(_sets(docs, words))
    classes = durable(slim.filter("n > 0 AND id IS NOT NULL").groupBy("n", "node", "check").agg(F.min("id").alias("rep")))
    members = connected_components(_candidates(docs.filter("id IS NOT NULL"), classes, words, plan)).join(classes.hint("merge"), "node").select(F.col("rep").alias("id"), "node", "n", "component")
    near = connected_components(_links(durable(members), docs, words, plan, exact=False)).join(classes.hint("merge"), "node").select(F.col("rep").alias("id"), "node", "n", "component")
    linked = connected_components(_links(durable(near), docs, words, plan, exact=True)).withColumnRenamed("component", "root")
    named = linked.join(classes.hint("merge"), "node").select("node", "root", "rep")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    labels = durable(named.join(smallest, "root").select("rep", "component"))
    labelled = classes.join(labels, "rep", "left").select("n", "node", "check", F.coalesce("component", "rep").alias("component"))
    out = slim.join(labelled, ["n", "node", "check"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
