"""N-gram Jaccard join with signature trees.

A document's set holds its distinct word shingles as 64-bit hashes. Two documents link when
100 * intersection >= percent * union. The result gives each document its class (documents with equal sets) and its
component (documents that links connect).

1. A count sketch of fixed size, merged from sketches of blocks of documents, says about how many documents hold each
   shingle. Prefixes take shingles from the rarest on, so that shared ones stay rare at any size; the sketch decides the
   order alone, so its errors cost time and no links.
2. Each document becomes set size, fingerprint, prefix (the first size - ceil(percent * size / 100) + 1 shingles of the
   order: linked documents share one of them) and a bitmap whose width grows with the set. Equal sets become one node.
3. Nodes meet under pairs of a prefix shingle and a class of sizes, the first level of the tree; a node enters its own
   class and the next one if a larger partner can be in it. In order of size, nodes whose neighbours under a key are
   too small and too large for a link leave it, and of keys with the same nodes one stays. Under each a signature tree
   is built:
   leaves hold bitmaps and sizes, inner nodes the OR of bitmaps, the range of sizes and the component if it is a single
   one. A dual traversal drops pairs of tree nodes of one component, of sizes too far apart, or whose largest possible
   overlap is too small.
4. In a first pass each node is paired with the nearest of its surviving partners in the leaves at hand (with all others
   if there is none) and with the next node of the tree's order; these pairs are verified exactly on whole sets, and the
   links join nodes into components. Near copies stand side by side in that order, so a group of them becomes one
   component at a cost that grows with its size.
5. In a second pass each node keeps the nearest of its surviving partners in other components. In a last pass the trees
   of keys whose nodes are still of several components give all surviving pairs, in blocks; both are verified in the
   same way, and components are formed again.

Within a component, pairs that others already connect need no check; links between different components are all found,
nothing is capped. What still grows with the square of its size is a group of nodes that bitmaps cannot tell apart and
that do not link: all its pairs are checked in the last pass.

Defined cases: a null or empty text has size 0 and links with nothing, its component is its own id; a text of fewer
words than a shingle is one shingle of all its words; rows that share an id are one node; a null id links with nothing
and has a null component; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, materialise
from .components import connected_components

#: Cells of the count sketch, and the parts in which it is merged.
SKETCH_BITS = 24
SKETCH_PARTS = 512
#: Shingles of documents that one block's sketch counts.
BLOCK_SHINGLES = 32_000_000
LEAF = 32
#: Bits of a bitmap for each shingle, at least.
BITS_EACH = 2
#: ... and in the second pass, which sees few nodes: more bits leave fewer pairs that do not link.
WIDE_BITS_EACH = 48
#: Greatest size over least size of a class, about.
CLASS_RATIO = 1.5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    g = h[: len(h) - size + 1]
    for k in range(1, size):
        g = (g * _STEP) ^ (h[k : len(h) - size + 1 + k] + np.uint64(k))
    return np.unique((g + np.uint64(size)) * _MIX)


def _spread(sets: np.ndarray) -> np.ndarray:
    return (sets ^ (sets >> np.uint64(29))) * _STEP


def bitmap(own: np.ndarray, each: int = BITS_EACH) -> bytes:
    """A bit for each shingle, in a power of two of bits: at least 64 and ``each`` for each shingle."""
    width = 64
    while width < each * len(own):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(_spread(own) >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


_CLASSES = [1]
while _CLASSES[-1] < 1 << 40:
    _CLASSES.append(max(_CLASSES[-1] + 1, int(_CLASSES[-1] * CLASS_RATIO)))


def meeting_keys(prefix: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Keys of the prefix shingles in each size class where a partner of at least this size can be."""
    own, most = bisect_right(_CLASSES, size), bisect_right(_CLASSES, 100 * size // percent)
    return np.concatenate([(prefix + np.uint64(k)) * _STEP for k in range(own, most + 1)])


def _cells(sets: np.ndarray) -> np.ndarray:
    """Cells of the sketch; by other bits of the hash than those that bitmaps use."""
    return ((sets * _STEP) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each: exact up to 31, then eight levels per doubling."""
    grown = 32 + np.floor(8 * (np.log2(np.maximum(counts, 32)) - 5))
    return np.where(counts < 32, counts, np.minimum(grown, 255)).astype(np.uint8)


def count_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """A byte for each cell, ascending with the number of documents that hold a shingle of the cell.

    Blocks count in one byte per cell, up to 255: a shingle in more of a block's documents is frequent anyway. The
    blocks' sketches are merged part by part; only the merged one, of 2^SKETCH_BITS bytes, comes to the driver.
    """
    part = (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = np.zeros(1 << SKETCH_BITS, np.uint8), 0

        def flush() -> pa.RecordBatch:
            found = [(k, pa.compress(own.tobytes(), "zstd", asbytes=True)) for k in range(SKETCH_PARTS) if (own := seen[k * part : (k + 1) * part]).any()]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["part", "seen"])

        for batch in batches:
            sets = [np.empty(0, np.uint64), *(shingles(text, n) for text in batch.column(0).to_pylist())]
            cells, counts = np.unique(_cells(np.concatenate(sets)), return_counts=True)
            seen[cells] = np.minimum(seen[cells] + counts, 255)
            size += sum(map(len, sets))
            if size > BLOCK_SHINGLES:
                yield flush()
                seen[:], size = 0, 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = -1, np.zeros(part, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([_levels(total).tobytes()], pa.binary())], names=["part", "levels"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != own:
                    if own >= 0:
                        yield done()
                    own, total = k, np.zeros(part, np.int64)
                total += np.frombuffer(pa.decompress(raw, part, "zstd"), np.uint8)
        if own >= 0:
            yield done()

    seen = map_arrow(docs.select(F.col("text").cast("binary")), count, "part int, seen binary", 256)
    merged = map_arrow(seen.repartition("part").sortWithinPartitions("part"), merge, "part int, levels binary").toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for k, raw in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        out[k * part : (k + 1) * part] = np.frombuffer(raw, np.uint8)
    return out


def signatures(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, size, fingerprint, prefix and bitmap of every document."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = held.value
        for batch in batches:
            sizes, first, second, prefixes, bitmaps = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, n)
                k = len(own)
                sizes.append(k)
                first.append(int(np.add.reduce(_spread(own), dtype=np.uint64).view(np.int64)))
                second.append(int(np.bitwise_xor.reduce(own * _STEP).view(np.int64)) if k else 0)
                # Rarest first, by the hash where the sketch has them equal: one order for all documents.
                rarest = own[np.argsort(levels[_cells(own)], kind="stable")[: k - -(-percent * k // 100) + 1]]
                prefixes.append(meeting_keys(rarest, k, percent).view(np.int64) if k else [])
                bitmaps.append(bitmap(own) if k else b"")
            arrays = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "fp_a", "fp_b", "prefix", "bits"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, sign, "doc_id long, n int, fp_a long, fp_b long, prefix array<long>, bits binary", 512)


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(token, n, node) -> the rows that stand beside one of a fitting size, in order of size under their token.

    One exchange and one sort; tasks look at neighbouring rows only, so a token of very many rows needs no memory.
    """

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            token, size, node = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            fits = (token[1:] == token[:-1]) & (100 * size[:-1].astype(np.int64) >= percent * size[1:].astype(np.int64))
            # The last row waits for its next neighbour; the one before it is only looked at again.
            settled = np.zeros(len(token), bool)
            settled[1:] |= fits
            settled[:-1] |= fits
            begin = 0 if held is None else len(held[0]) - 1
            keep = np.flatnonzero(settled[begin:-1]) + begin
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep])], names=["token", "node"])
            held = [x[-2:].copy() for x in (token, size, node)]
        if held is not None and len(held[0]) == 2 and held[0][0] == held[0][1] and 100 * int(held[1][0]) >= percent * int(held[1][1]):
            yield pa.RecordBatch.from_arrays([pa.array(held[0][-1:]), pa.array(held[2][-1:])], names=["token", "node"])

    dealt = rows.select("token", "n", "node").repartition("token").sortWithinPartitions("token", "n", "node")
    return map_arrow(dealt, beside, "token long, node long")


def wide_bitmaps(texts: DataFrame, n: int) -> DataFrame:
    """(node, text) -> own, n and a bitmap of WIDE_BITS_EACH bits for each shingle."""

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, n) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap(s, WIDE_BITS_EACH) for s in sets], pa.binary())], names=["own", "n", "bits"])

    return map_arrow(texts.select("node", "text"), widen, "own long, n int, bits binary", 256)


class SignatureTree:
    """Bitmaps and sizes of some documents, in order of size, under nodes of doubling width."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray, ties: np.ndarray | None = None):
        self.order = np.lexsort((*(() if ties is None else (ties,)), bits[:, 0], sizes))
        self.bits, self.sizes, self.groups = bits[self.order], sizes[self.order], groups[self.order]
        excess = self.sizes - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        n = len(sizes)
        starts = np.arange(0, n, LEAF)
        lone = np.minimum.reduceat(self.groups, starts) == np.maximum.reduceat(self.groups, starts)
        level = (np.bitwise_or.reduceat(self.bits, starts, axis=0), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts), np.maximum.reduceat(excess, starts), np.where(lone, self.groups[starts], -1))
        #: From the leaves up: OR of bitmaps, least size, greatest size, greatest number of hidden shingles, component.
        self.levels = [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), 2)
            lone = (np.minimum.reduceat(level[4], at) == np.maximum.reduceat(level[4], at)) & (level[4][at] >= 0)
            level = (np.bitwise_or.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at), np.where(lone, level[4][at], -1))
            self.levels.append(level)

    def leaf(self, k: int) -> slice:
        return slice(k * LEAF, min((k + 1) * LEAF, len(self.sizes)))


def _reachable(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some documents under tree nodes i of level x and j of level y may link and are not joined yet."""
    most = np.bitwise_count(x[0][i] & y[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(x[3][i], y[3][j])
    most = np.minimum(most, np.minimum(x[2][i], y[2][j]))
    fits = 100 * most >= percent * (x[1][i] + y[1][j] - most)
    near = (100 * x[2][i] >= percent * y[1][j]) & (100 * y[2][j] >= percent * x[1][i])
    return fits & near & ~((x[4][i] == y[4][j]) & (x[4][i] >= 0))


def traverse(x: SignatureTree, y: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, largest possible overlap) of pairs that the bounds leave; x and y may be one tree."""
    same = x is y
    low, high = len(x.levels) - 1, len(y.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        keep = _reachable(x.levels[low], i, y.levels[high], j, percent)
        i, j = i[keep], j[keep]
        if low == 0 and high == 0:
            break
        if low >= high:
            low, i, j = low - 1, np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
            keep = i < len(x.levels[low][1])
            i, j = i[keep], j[keep]
        if high > low or (same and high > 0 and high != low):
            high, i, j = high - 1, np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
            keep = j < len(y.levels[high][1])
            i, j = i[keep], j[keep]
        if same and low == high:
            keep = i <= j
            i, j = i[keep], j[keep]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        p, q = x.leaf(a), y.leaf(b)
        fits, most = _bounds(x, p, y, q, percent)
        if same and a == b:
            fits = np.triu(fits, 1)
        u, v = np.nonzero(fits)
        if len(u):
            yield x.order[u + p.start], y.order[v + q.start], most[u, v]


def _bounds(x: SignatureTree, p: slice, y: SignatureTree, q: slice, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents p of x and q of y: whether they may link and are not joined yet, and their largest possible overlap."""
    left, right = x.bits[p][:, None, :], y.bits[q][None, :, :]
    m, n = x.sizes[p][:, None], y.sizes[q][None, :]
    most = np.minimum(m - np.bitwise_count(left & ~right).sum(axis=2, dtype=np.int64), n - np.bitwise_count(right & ~left).sum(axis=2, dtype=np.int64))
    return (100 * most >= percent * (m + n - most)) & (x.groups[p][:, None] != y.groups[q][None, :]), most


def _fold(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


class Bucket:
    """The nodes that meet under one key, in a tree for each width of bitmaps."""

    def __init__(self, sizes: np.ndarray, groups: np.ndarray, bitmaps: list[bytes], ties: np.ndarray | None = None):
        self.sizes, self.groups, self.trees = sizes, groups, {}
        widths = np.array([len(b) for b in bitmaps])
        ties = np.arange(len(sizes)) if ties is None else ties
        for w in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == w)
            bits = np.frombuffer(b"".join(bitmaps[k] for k in rows), np.uint64).reshape(len(rows), w // 8)
            self.trees[w] = (rows, bits, SignatureTree(bits, sizes[rows], groups[rows], ties[rows]))

    def _tree(self, rows: np.ndarray, bits: np.ndarray) -> SignatureTree:
        return SignatureTree(bits, self.sizes[rows], self.groups[rows])

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, places, largest possible overlaps) of all pairs that may link; a tree against itself and the next width."""
        for w, (rows, _, tree) in self.trees.items():
            for u, v, most in traverse(tree, tree, percent):
                yield rows[u], rows[v], most
            if 2 * w in self.trees:
                wide, bits, _ = self.trees[2 * w]
                for u, v, most in traverse(tree, self._tree(wide, _fold(bits)), percent):
                    yield rows[u], wide[v], most

    def _like(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most / (self.sizes[i] + self.sizes[j] - most)

    def nearest(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Each node with its partner of greatest possible similarity; memory grows with the nodes, not with their pairs."""
        best, partner = np.full(len(self.sizes), -1.0), np.full(len(self.sizes), -1)
        for i, j, most in self.pairs(percent):
            _improve(best, partner, i, j, self._like(i, j, most))
            _improve(best, partner, j, i, self._like(i, j, most))
        found = np.flatnonzero(partner >= 0)
        return found, partner[found]

    def partners(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that join most of what belongs together, at a cost that grows with the nodes: each node with its nearest
        partner among the two leaves at hand, and with the next node of the tree's order, if they may link.

        A group of near copies is a chain in that order, so a pass over these pairs makes it one component. A node that
        finds none there is compared with all others: a node without a pair has no partner under this key.
        """
        best, partner = np.full(len(self.sizes), -1.0), np.full(len(self.sizes), -1)
        one, two = [], []
        for rows, _, tree in self.trees.values():
            place, n = rows[tree.order], len(rows)
            for k in range(0, n, LEAF):
                p, q = slice(k, min(k + LEAF, n)), slice(k, min(k + 2 * LEAF, n))
                fits, most = _bounds(tree, p, tree, q, percent)
                u, v = np.nonzero(np.triu(fits, 1))
                i, j, overlap = place[p][u], place[q][v], most[u, v]
                like = self._like(i, j, overlap)
                _improve(best, partner, i, j, like)
                _improve(best, partner, j, i, like)
                near = v == u + 1
                one.append(i[near])
                two.append(j[near])
        for w, (rows, bits, tree) in self.trees.items():
            alone = np.flatnonzero(partner[rows] < 0)
            if not len(alone):
                continue
            own = rows[alone]
            against = [(self._tree(own, bits[alone]), rows, tree)]
            if 2 * w in self.trees:
                wide, more, _ = self.trees[2 * w]
                against.append((self._tree(own, bits[alone]), wide, self._tree(wide, _fold(more))))
            if w % 2 == 0 and w // 2 in self.trees:
                against.append((self._tree(own, _fold(bits[alone])), self.trees[w // 2][0], self.trees[w // 2][2]))
            for lonely, others, other in against:
                for u, v, most in traverse(lonely, other, percent):
                    _improve(best, partner, own[u], others[v], self._like(own[u], others[v], most))
        found = np.flatnonzero(partner >= 0)
        return np.concatenate([found, *one]), np.concatenate([partner[found], *two])


def _improve(best: np.ndarray, partner: np.ndarray, i: np.ndarray, j: np.ndarray, like: np.ndarray) -> None:
    """Take j as the partner of i where their similarity is greater; of equal ones the smaller place."""
    order = np.lexsort((j, -like, i))
    first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
    i, j, like = i[first], j[first], like[first]
    better = (like > best[i]) | ((like == best[i]) & (j < partner[i]))
    best[i[better]], partner[i[better]] = like[better], j[better]


def bucket_pairs(sizes: np.ndarray, groups: np.ndarray, bitmaps: list[bytes], percent: int) -> list[tuple[int, int, int]]:
    """All pairs of a bucket as a list."""
    return [x for i, j, most in Bucket(sizes, groups, bitmaps).pairs(percent) for x in zip(i.tolist(), j.tolist(), most.tolist(), strict=True)]


#: Pairs of one Arrow batch of candidates, about.
BATCH_PAIRS = 1 << 18


def _candidates(met: DataFrame, percent: int, how: str) -> DataFrame:
    """(token, node, n, component, bits), sorted by token within partitions -> pairs (a, b) that the trees leave.

    ``how``: partners, nearest or pairs of each bucket. A task holds the nodes of one key and a block of pairs.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rest: list[pa.RecordBatch] = []
        size = 0

        def take() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                both = np.unique(np.stack([np.concatenate([np.minimum(a, b) for a, b in held]), np.concatenate([np.maximum(a, b) for a, b in held])], axis=1), axis=0)
                held.clear()
                size = 0
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal size
            token, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            sizes, comp = table.column(2).to_numpy().astype(np.int64), table.column(3).to_numpy()
            bits = table.column(4).to_pylist()
            edges = [0, *(np.flatnonzero(token[1:] != token[:-1]) + 1).tolist(), len(token)]
            for low, high in pairwise(edges):
                if high - low < 2:
                    continue
                own = node[low:high]
                bucket = Bucket(sizes[low:high], comp[low:high], bits[low:high], own)
                for i, j in [getattr(bucket, how)(percent)] if how != "pairs" else ((i, j) for i, j, _ in bucket.pairs(percent)):
                    held.append((own[i], own[j]))
                    size += len(i)
                    if size > BATCH_PAIRS:
                        yield from take()

        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            last = int(np.searchsorted(token, token[-1]))
            if last or (rest and rest[0].column(0)[0].as_py() != token[0]):
                # All groups but the last of this batch are whole now.
                yield from work(pa.Table.from_batches([*rest, batch.slice(0, last)]))
                rest = []
            rest.append(batch.slice(last))
        if rest:
            yield from work(pa.Table.from_batches(rest))
        yield from take()

    return map_arrow(met.repartition("token").sortWithinPartitions("token"), pairs, "a long, b long").distinct()


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for k in range(len(a)):
                if a[k] not in memo:
                    memo.clear()
                    memo[a[k]] = shingles(x[k], n)
                left, right = memo[a[k]], shingles(y[k], n)
                if len(left) > len(right):
                    left, right = right, left
                shared = 0
                if len(left):
                    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                    shared = int((right[at] == left).sum())
                if shared and 100 * shared >= percent * (len(left) + len(right) - shared):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return map_arrow(rows, check, "a long, b long", 256).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_shingles, class_id, component_id, one row per row."""
    docs, scratch = docs.select("doc_id", "text"), Scratch(docs.sparkSession)
    signed = scratch.table(signatures(docs, n, percent, count_sketch(docs, n)), "jaccard-signatures")
    fp = ["n", "fp_a", "fp_b"]
    classes = signed.where("n > 0").groupBy(*fp).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    classes = scratch.table(classes.withColumnsRenamed({c: f"{c}_c" for c in fp}), "jaccard-classes")
    same = (F.col("n") == F.col("n_c")) & (F.col("fp_a") == F.col("fp_a_c")) & (F.col("fp_b") == F.col("fp_b_c"))
    members = scratch.table(signed.select("doc_id", *fp).join(classes, same, "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id")), "jaccard-members")

    copies = members.where("class_id != doc_id").select("doc_id").distinct()
    nodes = signed.where("n > 0 AND doc_id IS NOT NULL").join(copies, "doc_id", "left_anti").withColumnRenamed("doc_id", "node")
    # Rows that share an id but not a text can be a copy and a node at once; such a node stays.
    both = members.where("n_shingles > 0").groupBy("doc_id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low != high").select("doc_id")
    nodes = nodes.unionByName(signed.where("n > 0").join(both, "doc_id", "left_semi").withColumnRenamed("doc_id", "node"))
    met = scratch.table(meetings(nodes.select("node", "n", F.explode("prefix").alias("token")), percent).distinct(), "jaccard-meetings")
    small = scratch.table(nodes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("own"), "n", "bits").dropDuplicates(["own", "n"]), "jaccard-bitmaps")
    scratch.drop("jaccard-signatures", "jaccard-classes")
    # Near copies meet under many keys; of keys with the same nodes one is enough.
    sets = [F.count(F.lit(1)).alias("members"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    once = met.groupBy("token").agg(*sets).groupBy("members", "low", "high", "x", "y").agg(F.min("token").alias("kept")).select("kept")
    met = scratch.table(met.join(once, F.col("token") == F.col("kept"), "left_semi"), "jaccard-met")
    scratch.drop("jaccard-meetings")

    def trees(frame: DataFrame, bitmaps: DataFrame, how: str) -> DataFrame:
        full = frame.join(bitmaps, F.col("node") == F.col("own")).select("token", "node", "n", "component", "bits")
        return _candidates(full, percent, how)

    near = scratch.table(trees(met.withColumn("component", F.col("node")), small, "partners"), "jaccard-near")
    scratch.drop("jaccard-bitmaps")
    involved = scratch.table(near.select(F.col("a").alias("involved")).union(near.select("b")).distinct(), "jaccard-involved")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").join(involved, F.col("doc_id") == F.col("involved"), "left_semi")
    texts = scratch.table(texts.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("binary").alias("text")), "jaccard-texts")
    found = scratch.table(verify(near, texts, n, percent), "jaccard-links")
    wide = wide_bitmaps(texts, n).dropDuplicates(["own", "n"])

    def unjoined(links: DataFrame, name: str) -> DataFrame:
        """Meetings under keys whose nodes are of several components; a node without a partner so far has none."""
        joined = connected_components(links).withColumnRenamed("node", "placed")
        placed = met.join(involved, F.col("node") == F.col("involved"), "left_semi").join(joined, F.col("node") == F.col("placed"), "left")
        placed = scratch.table(placed.select("token", "node", F.coalesce("component", "node").alias("component")), name)
        mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(F.col("token").alias("open"))
        return placed.join(mixed, F.col("token") == F.col("open"), "left_semi")

    # Nearest partners in other components join most of what belongs together, so few pairs are left for the last pass.
    again = scratch.table(trees(unjoined(found, "jaccard-placed-1"), wide, "nearest").join(near, ["a", "b"], "left_anti"), "jaccard-again")
    found = scratch.table(found.unionByName(verify(again, texts, n, percent)), "jaccard-found")
    tried = near.unionByName(again)
    rest = trees(unjoined(found, "jaccard-placed-2"), wide, "pairs").join(tried, ["a", "b"], "left_anti")
    more = scratch.table(verify(rest, texts, n, percent), "jaccard-more")
    final = connected_components(found.unionByName(more)).withColumnRenamed("node", "joined")
    scratch.drop_all(but=("jaccard-members",))
    return members.join(final, F.col("class_id") == F.col("joined"), "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """All links (a, b), a < b, between the class ids of documents with different sets.

    A link never leaves a component, so all pairs of a component's classes of fitting sizes are verified; the cost grows
    with the square of their number. Documents of one class link with each other and share the links of their class.
    """
    docs = docs.select("doc_id", "text")
    placed = materialise(jaccard_components(docs, n, percent), "jaccard-components")
    own = placed.where("n_shingles > 0 AND class_id IS NOT NULL").select("class_id", "n_shingles", "component_id").distinct()
    one, two = own.toDF("a", "size_a", "component_id"), own.toDF("b", "size_b", "component_id")
    fits = (100 * F.col("size_a") >= percent * F.col("size_b")) & (100 * F.col("size_b") >= percent * F.col("size_a"))
    pairs = materialise(one.join(two, "component_id").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct(), "jaccard-pairs")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("binary").alias("text"))
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return verify(pairs, texts.join(involved, "node", "left_semi"), n, percent)
