"""SimHash near-deduplication over a Gray-order hierarchical index.

Texts become 128-bit SimHash fingerprints of their weighted words. Fingerprints
within RADIUS bits of each other are found exactly: their bits are cut, around a
circle, into one more segment than RADIUS, so two such fingerprints agree in some
segment, and from one such segment on they differ at most l - 1 times in the first
l. By each segment the fingerprints, turned so that it leads, go to the block of
its bits, and are sorted there by Gray rank. Neighbours in that order share masked
patterns, which go up into a tree: a node has the first segments of all below it.
Tree is joined to tree from the top down: a pair of nodes goes, with all under it,
once the differences gathered in its segments are too many.
Pairs within the radius are candidates: a pair is a link only if its texts share
OVERLAP of their word shingles, as fingerprints of long texts come near by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.kernels import U64, Chunk, RangeHash, ShortHash, chunks, fold, mix64, ranges, release, row_of, runs
from quillspark.llm.kernels import BYTE_VALUES as VALUES
from quillspark.llm.runtime import free_name, small, written

RADIUS = 23

#: Words in a shingle, and the share of all shingles of two texts that a link must have in common.
SHINGLE = 3
OVERLAP = 0.2

#: Pairs of texts that are compared at a time.
_TEXTS = 256

#: Fingerprints in a part of a block, about.
BLOCK = 1 << 18

#: Edges that one task may take to form groups, in about 200 MB; beyond, stars are contracted round by round.
EDGES = 1 << 20

#: Pairs that are looked at in one go, about.
_PAIRS = 1 << 16

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

#: A nibble's four bits as four counters of 16 bits.
_SPREAD = np.array([sum(((n >> b) & 1) << (16 * b) for b in range(4)) for n in range(16)], dtype=U64)


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of each distinct word of each row: folded letters and digits, weight 2 + log2 of its count, floored."""
    data = fold(c.data)
    start, end = runs(_WORD[data], c.bounds)
    h = ShortHash(VALUES[data])(start, end)
    row = row_of(start, c.bounds)
    # sorted by row, then by hash: the place among the rows with words, below 2^20 in a chunk, takes the upper bits of a
    # key that sorts fast; the rest of the hash is the same whatever the chunk
    used = np.concatenate([np.zeros(1, np.int64), np.cumsum(row[1:] != row[:-1])]) if len(row) else row
    key = (used.astype(U64) << U64(44)) | (h >> U64(20))
    key, count = np.unique(key, return_counts=True)
    own = row[np.searchsorted(used, (key >> U64(44)).astype(np.int64))]
    return own, mix64(key << U64(20)), 2 + np.log2(count).astype(np.int64)


def fingerprints(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low 64 bits of each row's fingerprint, and whether the row has a word at all."""
    row, h, weight = features(c)
    out = np.zeros((c.rows, 2), dtype=U64)
    total = np.bincount(row, weights=weight, minlength=c.rows)
    if not len(row):
        return out[:, 0], out[:, 1], total > 0
    # pieces of at most 2048 words, so that no counter of 16 bits overflows
    place = np.arange(len(row))
    first = np.searchsorted(row, np.arange(c.rows))
    cut = np.flatnonzero((place - first[row]) % 2048 == 0)
    w = weight.astype(U64)
    for half in range(2):
        x = mix64(h ^ U64(0x9E37 + half))
        for nibble in range(16):
            lanes = _SPREAD[((x >> U64(4 * nibble)) & U64(15)).astype(np.int64)] * w
            part = np.add.reduceat(lanes, cut)
            for b in range(4):
                ones = np.bincount(row[cut], weights=((part >> U64(16 * b)) & U64(0xFFFF)).astype(np.float64), minlength=c.rows)
                out[:, half] |= (2 * ones > total).astype(U64) << U64(4 * nibble + b)
    return out[:, 0], out[:, 1], total > 0


def turned(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits turned left."""
    if bits >= 64:
        high, low, bits = low, high, bits - 64
    if not bits:
        return high, low
    up, down = U64(bits), U64(64 - bits)
    return (high << up) | (low >> down), (low << up) | (high >> down)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    out = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> U64(shift)
    return out


def cuts(radius: int) -> np.ndarray:
    """Bounds of the segments, one more than the radius, into which the 128 bits are cut."""
    return np.arange(radius + 2) * 128 // (radius + 1)


def chain(radius: int, lead: int) -> list[tuple[int, int]]:
    """(bits, most): how often the first bits of fingerprints turned to begin with segment `lead` may differ.

    Two fingerprints differ on average in less than one bit a segment, so from some
    segment on, around the circle, the first l segments differ at most l - 1 times
    for every l: for that segment every step of the chain holds.
    """
    at = cuts(radius)
    around = np.concatenate([at[lead:], at[1 : lead + 1] + 128]) - at[lead]
    return [(int(bits), most) for most, bits in enumerate(around[1:])]


class GrayIndex:
    """Codes in Gray order, under levels of nodes: a node is all codes that share the bits of a prefix.

    Codes with a common prefix are neighbours in Gray order. A level's nodes are
    given by the places of their first codes, and one past the last.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, prefixes: list[int]) -> None:
        order = np.argsort(gray_rank(high), kind="stable")
        self.order, self.high, self.low = order, high[order], low[order]
        n = len(high)
        self.first = []
        for bits in prefixes:
            p = self.high >> U64(64 - bits)
            self.first.append(np.concatenate([np.flatnonzero(np.concatenate([[n > 0], p[1:] != p[:-1]])), [n]]))
        self.first.append(np.arange(n + 1))

    def pattern(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The high bits of the first code of each node."""
        return self.high[self.first[level][nodes]]

    def children(self, level: int) -> np.ndarray:
        """For each node of a level, and one past the last, the place of its first child on the next."""
        return np.searchsorted(self.first[level + 1], self.first[level])


def levels(radius: int, lead: int, most: int) -> list[tuple[int, int]]:
    """The steps of the chain that are worth a level of nodes over so many codes."""
    return [(bits, some) for bits, some in chain(radius, lead) if bits <= min(63, 6 + int(most).bit_length())]


def close_pairs(left: GrayIndex, right: GrayIndex, radius: int, lead: int, steps: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of codes within the radius for which the chain holds; of one index with itself, each pair once.

    A pair of nodes goes on to its children only while the differences gathered in the bits that both share are few enough.
    """
    same = left is right
    later = [(bits, most) for bits, most in chain(radius, lead) if bits < 64 and (bits, most) not in steps]
    down = [(left.children(k), right.children(k)) for k in range(len(steps))]
    n, m = (len(x.first[0]) - 1 for x in (left, right))

    def below(level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs under pairs of nodes, of which a level holds about _PAIRS at a time, or a node's pairs with another's children."""
        if level < len(steps):
            bits, most = steps[level]
            apart = (left.pattern(level, a) ^ right.pattern(level, b)) >> U64(64 - bits)
            on = np.bitwise_count(apart) <= most
            a, b = a[on], b[on]
            la, lb = down[level]
            for part in _pieces(la[a + 1] - la[a]):
                x, y = a[part], b[part]
                rows = la[x + 1] - la[x]
                i, first, wide = ranges(la[x], rows), np.repeat(lb[y], rows), np.repeat(lb[y + 1] - lb[y], rows)
                for some in _pieces(wide):
                    deep, j = np.repeat(i[some], wide[some]), ranges(first[some], wide[some])
                    if same:
                        on = deep < j if level + 1 == len(steps) else deep <= j
                        deep, j = deep[on], j[on]
                    yield from below(level + 1, deep, j)
            return
        dh = left.high[a] ^ right.high[b]
        for bits, most in later:
            on = np.flatnonzero(np.bitwise_count(dh >> U64(64 - bits)) <= most)
            a, b, dh = a[on], b[on], dh[on]
        on = np.bitwise_count(dh) + np.bitwise_count(left.low[a] ^ right.low[b]) <= radius
        if on.any():
            yield left.order[a[on]], right.order[b[on]]

    for a in range(n):
        b = np.arange(a + (not steps) if same else 0, m)
        yield from below(0, np.full(len(b), a, dtype=np.int64), b)


def _pieces(counts: np.ndarray) -> Iterator[slice]:
    """Consecutive places whose counts add up to _PAIRS at most, or one whose own is more."""
    total = np.cumsum(counts)
    lo, done = 0, 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(total, done + _PAIRS, side="right")))
        yield slice(lo, hi)
        lo, done = hi, int(total[hi - 1])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place in the component of each of n places, given edges."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            deeper = root[root]
            if (deeper == root).all():
                break
            root = deeper
    return root


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs, fewer than n, that join all that all pairs join."""
    a = b = np.zeros(0, np.int64)
    held, some = [], 0
    for x, y in pairs:
        held.append((x, y))
        some += len(x)
        if some > max(_PAIRS, n):
            a, b = _tree(n, np.concatenate([a, *(p for p, _ in held)]), np.concatenate([b, *(q for _, q in held)]))
            held, some = [], 0
    return _tree(n, np.concatenate([a, *(p for p, _ in held)]), np.concatenate([b, *(q for _, q in held)]))


def _tree(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that are left when those that close a circle go."""
    root, left, right = np.arange(n, dtype=a.dtype), [], []
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        high, pick = np.unique(np.maximum(x, y), return_index=True)
        left.append(a[pick])
        right.append(b[pick])
        root[high] = np.minimum(x, y)[pick]
        while True:
            deeper = root[root]
            if (deeper == root).all():
                break
            root = deeper
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _block_bits(radius: int) -> list[int]:
    """Bits of the leading segment by which fingerprints are dealt, for each segment."""
    return np.minimum(np.diff(cuts(radius)), 8).tolist()


def _led(high: np.ndarray, low: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each segment and the block of each fingerprint by it."""
    for lead, (at, bits) in enumerate(zip(cuts(radius).tolist(), _block_bits(radius), strict=False)):
        yield lead, (turned(high, low, at)[0] >> U64(64 - bits)).astype(np.int64)


def _tiles(fps: DataFrame, radius: int, block: int) -> np.ndarray:
    """How many parts each block of each segment is cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((radius + 1, 256), dtype=np.int64)
        for b in batches:
            high, low = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for k in range(2))
            for lead, code in _led(high, low, radius):
                total[lead] += np.bincount(code, minlength=256)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total.ravel()[on])], names=["place", "n"])

    out = np.zeros((radius + 1) * 256, dtype=np.int64)
    for place, n in fps.select("high", "low").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect():  # 256 rows a segment at most
        out[place] = -(-n // block)
    return out.reshape(radius + 1, 256)


def close_edges(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, every: bool = False) -> DataFrame:
    """(a, b): pairs of ids of fingerprints (id, high, low) within the radius, enough to join all such pairs, transitively.

    With every, all such pairs whose labels, in a fourth column, differ. Each
    fingerprint goes to one block a segment, radius + 1 in all; a block of more than
    `block` fingerprints is cut into parts, and pairs of parts are joined.
    """
    tiles = _tiles(fps, radius, block)
    at = cuts(radius).tolist()
    columns = 4 if every else 3

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for k in range(columns)], axis=1)
            tasks, sides, packed = [], [], []
            for lead, code in _led(rows[:, 1], rows[:, 2], radius):
                cut = tiles[lead][code]
                tile = (mix64(rows[:, 0]) % cut.astype(U64)).astype(np.int64)
                order = np.lexsort((tile, code))
                code, tile, cut = code[order], tile[order], cut[order]
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (tile[1:] != tile[:-1])])) if len(code) else np.zeros(0, np.int64)
                for lo, hi in zip(first.tolist(), np.append(first[1:], len(code)).tolist(), strict=True):
                    data = rows[order[lo:hi]].tobytes()
                    mine = int(tile[lo])
                    for other in range(int(cut[lo])):
                        x, y = min(mine, other), max(mine, other)
                        tasks.append(((lead << 8 | int(code[lo])) << 24 | x) << 24 | y)
                        sides.append(int(mine != x))
                        packed.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array(sides, pa.int32()), pa.array(packed, pa.binary())], names=["task", "side", "packed"])

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = key[0].as_py()
        lead = task >> 56
        both = (task >> 24) & 0xFFFFFF != task & 0xFFFFFF
        cells: list[list[bytes]] = [[], []]
        for b in batches:
            for side, cell in zip(b.column("side").to_pylist(), b.column("packed").to_pylist(), strict=True):
                cells[side].append(cell)
        held = [np.frombuffer(b"".join(cells[side]), U64).reshape(-1, columns) for side in range(2 if both else 1)]
        cells.clear()
        steps = levels(radius, lead, max(map(len, held)))
        index = [GrayIndex(*turned(x[:, 1], x[:, 2], at[lead]), [bits for bits, _ in steps]) for x in held]
        base = len(held[0]) if both else 0
        pairs = ((a, b + base) for a, b in close_pairs(index[0], index[-1], radius, lead, steps))
        ids = np.concatenate([x[:, 0] for x in held]).view(np.int64)
        if every:
            label = np.concatenate([x[:, 3] for x in held])
            for a, b in pairs:  # given on as they are found: their number has no bound
                on = label[a] != label[b]
                if on.any():
                    yield from _batches(["a", "b"], ids[a[on]], ids[b[on]])
            return
        a, b = forest(len(ids), pairs)
        release()
        yield from _batches(["a", "b"], ids[a], ids[b])

    return fps.select("id", "high", "low", *["label"] * every).mapInArrow(deal, "task long, side int, packed binary").groupBy("task").applyInArrow(join, "a long, b long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids on edges (a, b), sorted, and a forest of places among them that joins what the edges join.

    Edges that close a circle go as soon as as many are gathered as the forest had
    edges, so a task holds about twice that many, never all.
    """
    none = np.zeros(0, np.int64)
    held, some = [(none, none)], 0

    def grown() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        ids = np.concatenate([a, b])
        ids.sort()
        ids = ids[np.concatenate([[True], ids[1:] != ids[:-1]])] if len(ids) else ids
        narrow = np.int32 if len(ids) < 1 << 31 else np.int64
        a = np.searchsorted(ids, a).astype(narrow)
        b = np.searchsorted(ids, b).astype(narrow)
        return ids, *_tree(len(ids), a, b)

    kept = 0
    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)))
        some += batch.num_rows
        if some > max(1 << 20, kept):
            ids, a, b = grown()
            held.append((ids[a], ids[b]))
            kept, some = len(a), 0
    out = grown()
    release()
    return out


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in columns], names=names)


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(id, root) for every id on an edge (a, b): the least id of its component."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if edges.count() <= most:

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, a, b = _gathered(batches)
            yield from _batches(["id", "root"], ids, ids[roots(len(ids), a, b)])

        return edges.repartition(1).mapInArrow(label, "id long, root long")
    while True:  # large stars, then small stars, till nothing changes
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("root").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("root"))
        small_star = large.join(down, "b")
        new = written(small_star.select(F.col("root").alias("a"), "b").unionByName(small_star.select(F.col("root").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "stars")
        if not new.exceptAll(edges).take(1) and not edges.exceptAll(new).take(1):
            return new.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(new.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
        edges = new


def _printed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, high, low) of all rows; nulls for rows that are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            high, low, known = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, bool)]
            for c in chunks(b.column(2)):
                h, m, k = fingerprints(c)
                high.append(h)
                low.append(m)
                known.append(k)
            none = ~np.concatenate(known)
            cells = [pa.array(np.concatenate(x).view(np.int64), mask=none) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], names=["id", "text_hash", "high", "low"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.when(F.col(id_col).isNotNull(), F.col(text_col)).alias("text"))
    return texts.mapInArrow(run, "id long, text_hash long, high long, low long")


def shingles(texts: pa.Array) -> np.ndarray:
    """Sorted keys of the distinct shingles of up to 2^8 texts, the row in the upper bits; a text of fewer words is one shingle."""
    found = [np.zeros(0, U64)]
    for c in chunks(texts):
        data = fold(c.data)
        start, end = runs(_WORD[data], c.bounds)
        h = RangeHash(data)(start, end)
        row = row_of(start, c.bounds)
        last = np.searchsorted(row, row, side="right")
        at = np.arange(len(row))
        first = np.flatnonzero((at + SHINGLE <= last) | (at == np.searchsorted(row, row)))
        key = RangeHash(h)(first, np.minimum(first + SHINGLE, last[first]))
        found.append(((row[first] + c.lo).astype(U64) << U64(56)) | (key >> U64(8)))
    return np.unique(np.concatenate(found))


def alike(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether each text of up to 2^8 shares OVERLAP of all shingles, its own and the other's, with the other."""
    x, y = shingles(left), shingles(right)
    own, other, both = (np.bincount((k >> U64(56)).astype(np.int64), minlength=len(left)) for k in (x, y, np.intersect1d(x, y, assume_unique=True)))
    return (both > 0) & (both >= OVERLAP * (own + other - both))


def _alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of text hashes whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [alike(b.column(2).slice(k, _TEXTS), b.column(3).slice(k, _TEXTS)) for k in range(0, b.num_rows, _TEXTS)]
            yield b.select([0, 1]).filter(pa.array(np.concatenate([np.zeros(0, bool), *on])))

    ends = pairs.select(F.col("a").alias("text_hash")).unionByName(pairs.select(F.col("b").alias("text_hash"))).distinct()
    shown = written(nodes.join(ends, "text_hash", "left_semi").select("id", "text_hash"), "shown")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).join(small(shown), ["id", "text_hash"], "left_semi")
    left, right = (texts.select(F.col("text_hash").alias(k), F.col("text").alias(f"_{k}")) for k in ("a", "b"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long").distinct(), "links")


def _links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, radius: int, block: int, edges: int) -> DataFrame:
    """(a, b): pairs of text hashes within the radius and alike that join all such pairs, transitively.

    First a forest of candidates is checked. Where all of a tree's are alike, no
    other candidate could join more. The texts of other trees are compared in all
    candidate pairs that the links so far leave apart.
    """
    fps = written(nodes.groupBy("high", "low").agg(F.min("text_hash").alias("id")), "distinct-fingerprints")
    same = nodes.join(fps.withColumnRenamed("id", "a"), ["high", "low"]).where("text_hash <> a").select("a", F.col("text_hash").alias("b"))
    order = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = close_edges(fps, radius, block).unionByName(same)
    pairs = written(_spanning(written(pairs.select(*order).distinct(), "candidates"), edges), "tree")
    links = _alike(docs, nodes, pairs, id_col, text_col)
    apart = written(pairs.join(links, ["a", "b"], "left_anti"), "unlike")
    if not apart.take(1):
        return links
    trees = written(components(pairs, edges), "trees")
    doubtful = trees.join(apart.select(F.col("a").alias("id")), "id", "left_semi").select("root").distinct()
    named = components(links, edges).withColumnRenamed("root", "label")
    rest = trees.join(doubtful, "root", "left_semi").select("id").join(named, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    rest = written(rest.join(nodes.select(F.col("text_hash").alias("id"), "high", "low"), "id"), "doubtful")
    more = written(close_edges(rest, radius, block, every=True).select(*order).distinct().join(apart, ["a", "b"], "left_anti"), "other-candidates")
    return links.unionByName(_alike(docs, nodes, more, id_col, text_col))


def _spanning(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs that join all that these join, without those that close a circle; all of them where they are too many for a task."""
    if pairs.count() > most:
        return pairs

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, a, b = _gathered(batches)
        yield from _batches(["a", "b"], ids[a], ids[b])

    return pairs.repartition(1).mapInArrow(tree, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, block: int, edges: int) -> tuple[DataFrame, DataFrame]:
    """The rows with fingerprints, and (text_hash, group_id, members) of every distinct text."""
    rows = written(_printed(docs, id_col, text_col), "fingerprints")
    known = rows.where("high IS NOT NULL")
    nodes = written(known.groupBy("high", "low", "text_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct-texts")
    links = _links(docs, nodes, id_col, text_col, radius, block, edges)
    ids = nodes.select("text_hash", "id")
    links = links.join(ids.withColumnsRenamed({"text_hash": "a", "id": "_a"}), "a").join(ids.withColumnsRenamed({"text_hash": "b", "id": "_b"}), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    named = written(components(links, edges), "components")
    linked = nodes.join(small(named), "id", "left").select("text_hash", "n", F.coalesce("root", "id").alias("group_id"))
    sizes = linked.groupBy("group_id").agg(F.sum("n").alias("members")).where("members > 1")
    return rows, linked.join(small(sizes), "group_id", "left").select("text_hash", "group_id", F.coalesce("members", F.lit(1)).alias("members"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block: int = BLOCK, edges: int = EDGES) -> DataFrame:
    """For every row: id, group_id, members, is_duplicate.

    Texts with fingerprints within the radius that share OVERLAP of their word
    shingles are linked; a group is all that links join.
    group_id is its smallest id, members its rows, is_duplicate whether another
    id stays for it. Repeated rows count as members. A null or wordless text,
    and a row with a null id, is not compared: it is a group of its own. Rows
    that share an id are linked with each other. Ids are integers; an id column with
    the name of a result's gets "_" after it. Other columns are ignored. An empty table gives no rows.
    """
    rows, table = _grouped(docs, id_col, text_col, radius, block, edges)
    # texts that are not compared are in no group, whatever their hash
    found = rows.where("high IS NOT NULL").join(small(table), "text_hash").select("id", "group_id", "members")
    found = found.unionByName(rows.where("high IS NULL").select("id", F.lit(None).cast("long").alias("group_id"), F.lit(None).cast("long").alias("members")))
    group = F.coalesce("group_id", "id")
    return found.select(F.col("id").alias(free_name(id_col, "group_id", "members", "is_duplicate")), group.alias("group_id"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce(F.col("id") != group, F.lit(False)).alias("is_duplicate"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block: int = BLOCK, edges: int = EDGES) -> DataFrame:
    """docs with one row left of each group of near_duplicates(): the one with the smallest id.

    All columns stay as they are, whatever their names. Rows that are not
    compared stay. Of repeated rows with a group's smallest id, one stays; a row of
    another text under that same id stays too.
    """
    rows, table = _grouped(docs, id_col, text_col, radius, block, edges)
    found = rows.where("high IS NOT NULL").join(small(table.where("members > 1")), "text_hash")
    gone = found.where("id <> group_id").select("id", "text_hash").distinct()
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("_row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    left = keyed.join(small(written(gone, "near-copies")), ["id", "text_hash"], "left_anti")
    again = written(found.where("id = group_id").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-rows")
    if again.take(1):
        keys = ["id", "text_hash"]
        left = left.join(small(again), keys, "left_anti").unionByName(left.join(small(again), keys, "left_semi").dropDuplicates(keys).select(left.columns))
    return left.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
