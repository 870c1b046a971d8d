"""Substring deduplication by fixed-block anchors.

The reference blocks of a text are its consecutive, non-overlapping runs of
BLOCK words. Every rolling window of BLOCK words probes the index of all blocks;
a block that occurs twice is an anchor. As 2 * BLOCK words hold a whole block
wherever they begin, any repeat of MIN_WORDS words holds an anchor. Around each
anchor all stretches of MIN_WORDS words are compared with those around its other
occurrences, and those that agree grow together to maximal exact repeats, as long
as the same documents share them. Stretches and anchors with a large share of all
are counted first: what is known of such a stretch goes to every task, so its
occurrences meet nowhere, and those of such an anchor are dealt out by stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.kernels import U64, Chunk, HashTable, RangeHash, ShortHash, chunks, mix64, ranges, row_of, runs
from quillspark.llm.kernels import BYTE_VALUES as VALUES
from quillspark.llm.runtime import free_name, written

BLOCK = 25
MIN_WORDS = 50

#: Anchors that may be sent to every executor; beyond, a filter of them is.
ANCHORS = 1 << 22

#: Anchors whose filter, of 2 to 4 bytes each, may be sent to every executor; beyond, they are joined in a shuffle.
FILTERED = 1 << 26

#: Share of all stretches from which a stretch, or an anchor by those around it, is heavy; there are at most two by its inverse.
HEAVY = 1e-5

#: Windows that a task gathers before it sends them on.
_FLUSH = 1 << 21

_INK = np.zeros(256, dtype=bool)
_INK[33:] = True


class Words:
    """Words of a chunk (runs without white space), and hashes of the exact bytes of any run of words."""

    def __init__(self, c: Chunk) -> None:
        self.start, self.end = runs(_INK[c.data], c.bounds)
        self.row = row_of(self.start, c.bounds)
        self.first = np.searchsorted(self.row, np.arange(c.rows + 1))
        self._hash = RangeHash(c.data)
        self._check = ShortHash(VALUES[c.data])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of so many words within a row."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, self.hash(at, size)

    def hash(self, at: np.ndarray, size: int) -> np.ndarray:
        return self._hash(self.start[at], self.end[at + size - 1])

    def check(self, at: np.ndarray, size: int) -> np.ndarray:
        """32 more bits, of another hash: with those of hash() they stand for the bytes."""
        return (self._check(self.start[at], self.end[at + size - 1]) >> U64(32)).astype(np.uint32)


def _short(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash; a chance agreement costs a needless look, never a wrong result."""
    return h >> U64(16)


def pack(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences of four bytes where they fit."""
    if len(sorted_keys):
        steps = np.diff(sorted_keys)
        if not len(steps) or steps.max() < U64(1 << 32):
            return b"\1" + sorted_keys[:1].tobytes() + steps.astype("<u4").tobytes()
    return b"\0" + sorted_keys.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[0]:
        return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 1), np.frombuffer(data, "<u4", -1, 9).astype(U64)]), dtype=U64)
    return np.frombuffer(data, "<u8", -1, 1)


def planes(values: np.ndarray) -> bytes:
    """Differences of neighbours, byte plane by byte plane, which compress well."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def even_keys(spark: SparkSession, each: int) -> np.ndarray:
    """Whole numbers of which a shuffle by their hash brings `each` to every partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some, taken = 4 * each * parts + 64, {}
    while sum(map(len, taken.values())) < each * parts:
        rows = spark.range(0, some, 1, 1).select(F.col("id").cast("int").alias("key")).select("key", F.pmod(F.hash("key"), F.lit(parts)).alias("part")).collect()  # some a partition
        taken = {}
        for key, part in rows:
            if len(taken.setdefault(part, [])) < each:
                taken[part].append(key)
        some *= 2
    return np.array([keys[k] for k in range(each) for _, keys in sorted(taken.items())], dtype=np.int64)


def _probes(block: int, keys_of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """By hash range: blocks that repeat here, other blocks, and other windows."""
    buckets = len(keys_of)

    def flush(every: list[np.ndarray], aligned: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(every))
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        is_block = np.zeros(len(keys), dtype=bool)
        is_block[np.searchsorted(keys, np.concatenate(aligned))] = True
        bucket = (keys >> U64(16)) * U64(buckets) >> U64(32)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
        rows = []
        for k in np.flatnonzero(np.diff(cut)):
            part = slice(cut[k], cut[k + 1])
            x, b, many = keys[part], is_block[part], count[part] > 1
            rows.append((int(keys_of[k]), pack(x[b & many]), pack(x[b & ~many]), pack(x[~b])))
        cells = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cells[1:])], names=["bucket", "hot", "blocks", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: list[np.ndarray] = []
        aligned: list[np.ndarray] = []
        held = 0
        for b in batches:
            for c in chunks(b.column(0)):
                w = Words(c)
                at, h = w.windows(block)
                h = _short(h)
                every.append(h)
                aligned.append(h[(at - w.first[w.row[at]]) % block == 0])
                held += len(h)
                if held >= _FLUSH:
                    yield flush(every, aligned)
                    every, aligned, held = [], [], 0
        if held:
            yield flush(every, aligned)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """The blocks of a hash range that occur again, as a block or as any window."""
    hot, blocks, windows = ([unpack(x) for x in table.column(name).to_pylist()] for name in ("hot", "blocks", "windows"))
    all_blocks = np.unique(np.concatenate([*hot, *blocks]))
    seen = np.zeros(len(all_blocks), dtype=np.int32)
    for x in hot:
        seen[np.searchsorted(all_blocks, x)] += 2
    if len(all_blocks):
        for x in [*blocks, *windows]:
            at = np.minimum(np.searchsorted(x, all_blocks), max(0, len(x) - 1))
            if len(x):
                seen += x[at] == all_blocks
    return pa.table({"anchor": pa.array(all_blocks[seen > 1].view(np.int64))})


def anchors(docs: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(anchor): short hashes of the blocks that occur more than once."""
    sent = docs.select(F.col(text_col)).mapInArrow(_probes(block, even_keys(docs.sparkSession, 2)), "bucket int, hot binary, blocks binary, windows binary")
    return sent.groupBy("bucket").applyInArrow(_repeated, "anchor long")


class Exact:
    """All anchors; a worker makes their table once, at first use, as it keeps what was broadcast."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self._table = keys, None

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = HashTable(self.keys)
        return self._table.find(h) >= 0


class Filter:
    """A Bloom filter of anchors: four bits in each of two words of 64, as hashes choose them.

    What it takes for an anchor by chance, under 1 window in 1,000, costs a needless
    look, never a wrong result: equal stretches have equal windows, so they still
    meet, and are told from others by their own hashes.
    """

    #: Words, as a power of 2, in a part that one task makes.
    PART = 17

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.bits = len(words).bit_length() - 1

    @staticmethod
    def places(h: np.ndarray, bits: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        """The word of each hash, and its bits there."""
        x = mix64(h ^ U64(0x5BD1 + which))
        mask = np.zeros(len(h), dtype=U64)
        for k in range(4):
            mask |= U64(1) << ((x >> U64(6 * k)) & U64(63))
        return (x >> U64(64 - bits)).astype(np.int64), mask

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be an anchor's; every anchor's is."""
        out = np.ones(len(h), dtype=bool)
        at = np.arange(len(h))
        for which in range(2):
            word, mask = self.places(h[at], self.bits, which)
            on = self.words[word] & mask == mask
            out[at[~on]] = False
            at = at[on]
        return out

    @staticmethod
    def of(hot: DataFrame, count: int) -> Filter:
        """A filter of (anchor), made in parts."""
        bits = max(10, (count // 4).bit_length())
        part = min(Filter.PART, bits)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                for which in range(2):
                    word, mask = Filter.places(h, bits, which)
                    yield pa.RecordBatch.from_arrays([pa.array((word >> part).astype(np.int32)), pa.array(word & ((1 << part) - 1)), pa.array(mask.view(np.int64))], names=["part", "word", "mask"])

        def made(key: tuple, table: pa.Table) -> pa.Table:
            words = np.zeros(1 << part, dtype=U64)
            np.bitwise_or.at(words, table.column("word").to_numpy(), table.column("mask").to_numpy().view(U64))
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary())})

        words = np.zeros(1 << bits, dtype=U64)
        for k, x in hot.mapInArrow(dealt, "part int, word long, mask long").groupBy("part").applyInArrow(made, "part int, words binary").collect():  # 2 to 4 bytes an anchor
            words[k << part : (k + 1) << part] = np.frombuffer(x, U64)
        return Filter(words)


_STRETCH = "bucket int, hash binary, check binary, id binary, text_hash binary, word binary, start binary, stop binary"
_NAMES = [x.split()[0] for x in _STRETCH.split(", ")]
_SPAN = "id long, text_hash long, word int, past int, start int, stop int, first_id long, partners long"


def _anchored(c: Chunk, w: Words, block: int, least: int, table: Exact | Filter | None, places: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """First word of every stretch of `least` words that holds an anchor, and its first anchor."""
    if table is not None:
        at, h = w.windows(block)
        h = _short(h)
        hit = table.holds(h)
        at, h = at[hit], h[hit]
    else:
        lists = [np.asarray(p.as_py() or [], dtype=np.int64) + w.first[k] for k, p in enumerate(places.slice(c.lo, c.rows))]
        at = np.sort(np.concatenate(lists))
        h = _short(w.hash(at, block))
    if not len(at):
        return at, h
    row = w.row[at]
    before = np.full(len(at), -1, dtype=np.int64)
    before[1:] = at[:-1]
    low = np.maximum.reduce([before + 1, at - (least - block), w.first[row]])
    high = np.minimum(at, w.first[row + 1] - least)
    count = np.maximum(high - low + 1, 0)
    return ranges(low, count), np.repeat(h, count)


class _Anchors:
    """The anchors as tasks get them: all of them or a filter sent to every task, or as each row's places."""

    def __init__(self, block: int, least: int, sent) -> None:
        self.block, self.least, self.sent = block, least, sent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Chunk, Words, np.ndarray, np.ndarray]]:
        """(batch, chunk, words, first words of stretches, their anchors)."""
        table = self.sent.value if self.sent is not None else None
        for b in batches:
            for c in chunks(b.column(2)):
                w = Words(c)
                s, anchor = _anchored(c, w, self.block, self.least, table, b.column(3) if table is None else None)
                if len(s):
                    yield b, c, w, s, anchor


def _often(found: _Anchors) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches (kind 0) and anchors (1) with a large share of those that a task has gathered, and how many (2): what has such a share of all has it in some gathering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        some = 0

        def flush() -> pa.RecordBatch:
            kinds, keys, counts = [np.array([2])], [np.zeros(1, U64)], [np.array([some])]
            for kind, x in enumerate(map(np.concatenate, zip(*held, strict=True))):
                key, n = np.unique(x, return_counts=True)
                on = n >= max(2, HEAVY * some)
                kinds.append(np.full(int(on.sum()), kind))
                keys.append(key[on])
                counts.append(n[on])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts), pa.int64())], names=["kind", "key", "n"])

        for _, _, w, s, anchor in found(batches):
            held.append((w.hash(s, found.least), anchor))
            some += len(s)
            if some >= _FLUSH:
                yield flush()
                held, some = [], 0
        if some:
            yield flush()

    return run


def _known(found: _Anchors, heavy: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each gathering of a task has of the heavy stretches: places, least id, and the sum of its rows' random values, in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(heavy)
        for b, c, w, s, _ in found(batches):
            h = w.hash(s, found.least)
            on = np.flatnonzero(table.find(h) >= 0)
            if not len(on):
                continue
            s, h = s[on], h[on]
            check, row = w.check(s, found.least), w.row[s]
            order = np.lexsort((row, check, h))
            h, check, row = h[order], check[order], row[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
            first = np.flatnonzero(new)
            ids = b.column(0).to_numpy(zero_copy_only=False)[c.lo + row].astype(np.int64)
            own = np.where(new | np.concatenate([[True], row[1:] != row[:-1]]), mix64(ids.view(U64)), U64(0))
            halves = [np.add.reduceat(x, first).astype(np.int64) for x in (own & U64(0xFFFFFFFF), own >> U64(32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(check[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(h)))), pa.array(np.minimum.reduceat(ids, first)), *map(pa.array, halves)], names=["key", "check", "n", "origin", "low", "high"]
            )

    return run


class _Heavy:
    """The heavy stretches that occur again, with the first document that has each and the value of the set of its rows; and the heavy anchors."""

    def __init__(self, key: np.ndarray, check: np.ndarray, origin: np.ndarray, partners: np.ndarray, anchors: np.ndarray) -> None:
        self.check, self.origin, self.partners = check, origin, partners
        self._table, self._anchors = HashTable(self._mixed(key, check)), HashTable(anchors)

    @staticmethod
    def _mixed(key: np.ndarray, check: np.ndarray) -> np.ndarray:
        return key ^ mix64(check)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        return self._table.find(self._mixed(key, check))

    def anchor(self, h: np.ndarray) -> np.ndarray:
        return self._anchors.find(h) >= 0


def _heavy(rows: DataFrame, found: _Anchors) -> _Heavy:
    """Both tables hold at most about the inverse of HEAVY."""
    often = written(rows.mapInArrow(_often(found), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "often")
    total = (often.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first() or (0,))[0]
    kept = often.where((F.col("kind") < 2) & (F.col("n") >= max(2, HEAVY * total))).toPandas()
    keys, anchor = (kept.loc[kept["kind"] == kind, "key"].to_numpy().astype(np.int64).view(U64) for kind in (0, 1))
    known = rows.mapInArrow(_known(found, keys), "key long, check long, n long, origin long, low long, high long")
    stats = known.groupBy("key", "check").agg(F.sum("n").alias("n"), F.min("origin").alias("origin"), F.sum("low").alias("low"), F.sum("high").alias("high")).where("n > 1").toPandas()
    low, high = (stats[k].to_numpy().astype(np.int64).view(U64) for k in ("low", "high"))
    return _Heavy(stats["key"].to_numpy().astype(np.int64).view(U64), stats["check"].to_numpy().astype(U64), stats["origin"].to_numpy().astype(np.int64), (low + (high << U64(32))).view(np.int64), anchor)


def _runs(same_text: np.ndarray, word: np.ndarray, origin: np.ndarray, partners: np.ndarray, merged: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of neighbouring stretches; unless merged, the same documents have all of a run's."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes_on = same_text & (word[1:] - word[:-1] <= 1)
    if not merged:
        goes_on &= (origin[1:] == origin[:-1]) & (partners[1:] == partners[:-1])
    a = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return a, np.append(a[1:], len(word)) - 1


def _stretches(found: _Anchors, keys_of: np.ndarray, heavy, merged: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every stretch sent by its first anchor, or by itself where that one is heavy; runs of heavy ones as the spans that they are, under the last third of the keys."""
    buckets = len(keys_of) * 2 // 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for b, c, w, s, anchor in found(batches):
            h, check = w.hash(s, found.least), w.check(s, found.least)
            r = w.row[s]
            letters = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
            base = letters[c.bounds[r]]
            ids, texts = (b.column(k).to_numpy(zero_copy_only=False)[c.lo + r].astype(np.int64) for k in (0, 1))
            word, start, stop = s - w.first[r], letters[w.start[s]] - base, letters[w.end[s + found.least - 1]] - base
            at = known.find(h, check.astype(U64))
            on = np.flatnonzero(at >= 0)
            if len(on):
                at = at[on]
                a, z = _runs(r[on][1:] == r[on][:-1], word[on], known.origin[at], known.partners[at], merged)
                spans = ids[on[a]], texts[on[a]], word[on[a]], word[on[z]] + found.least, start[on[a]], stop[on[z]], known.origin[at[a]], known.partners[at[a]]
                cells = [b"", *(x.astype("<i8").tobytes() for x in spans[:6]), np.concatenate(spans[6:]).astype("<i8").tobytes()]
                order = [cells[7], *cells[1:7]]
                yield pa.RecordBatch.from_arrays([pa.array([keys_of[buckets + int(mix64(ids[:1].view(U64))[0]) % (len(keys_of) - buckets)]], pa.int32()), *(pa.array([x], pa.binary()) for x in order)], names=_NAMES)
            rest = np.flatnonzero(~np.isin(np.arange(len(s)), on, assume_unique=True)) if len(on) else np.arange(len(s))
            if not len(rest):
                continue
            by = np.where(known.anchor(anchor[rest]), h[rest] >> U64(16), anchor[rest])
            bucket = ((by >> U64(16)) * U64(buckets) >> U64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rest, bucket = rest[order], bucket[order]
            cells = [x[rest] for x in (h.view(np.int64), check, ids, texts, word, start, stop)]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cut))
            packed = [[x[cut[k] : cut[k + 1]].tobytes() if i < 2 else planes(x[cut[k] : cut[k + 1]]) for k in used] for i, x in enumerate(cells)]
            yield pa.RecordBatch.from_arrays([pa.array(keys_of[used], pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=_NAMES)

    return run


def _agreeing(least: int, merged: bool, ready: frozenset[int]) -> Callable[[tuple, pa.Table], pa.Table]:
    """Runs of neighbouring stretches that occur again, in the same rows unless merged, with the first document that has the run's first one; under the keys given are spans already."""

    def spans(columns: list[np.ndarray]) -> pa.Table:
        names = [x.split()[0] for x in _SPAN.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(x.astype(np.int64), pa.int64()).cast(k) for n, k, x in zip(names, kinds, columns, strict=True)})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() in ready:
            plain = [np.concatenate([np.frombuffer(x, "<i8") for x in table.column(n).to_pylist()]) for n in _NAMES[2:]]
            last = [np.frombuffer(x, "<i8").reshape(2, -1) for x in table.column("hash").to_pylist()]
            return spans([*plain, *np.concatenate(last, axis=1)])
        h, check = (np.concatenate([np.frombuffer(x, kind) for x in table.column(n).to_pylist()]) for n, kind in (("hash", np.int64), ("check", np.uint32)))
        ids, texts, word, start, stop = (np.concatenate([from_planes(x, np.int64) for x in table.column(n).to_pylist()]) for n in _NAMES[3:])
        order = np.lexsort((word, texts, ids, check, h))
        h, check, ids, texts, word, start, stop = (x[order] for x in (h, check, ids, texts, word, start, stop))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        keep = np.repeat(size > 1, size)
        origin = np.repeat(ids[first], size)[keep]
        # a sum of random values of the rows, each once, stands for the set of them
        row = np.flatnonzero(new | np.concatenate([[True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])]))
        least_word = np.repeat(word[row], np.diff(np.append(row, len(h))))
        own = np.where(word == least_word, mix64(ids.view(U64)), U64(0))
        partners = np.repeat(np.add.reduceat(own, first).view(np.int64), size)[keep]
        ids, texts, word, start, stop = (x[keep] for x in (ids, texts, word, start, stop))
        order = np.lexsort((word, texts, ids))
        ids, texts, word, start, stop, origin, partners = (x[order] for x in (ids, texts, word, start, stop, origin, partners))
        a, z = _runs((ids[1:] == ids[:-1]) & (texts[1:] == texts[:-1]), word, origin, partners, merged)
        return spans([ids[a], texts[a], word[a], word[z] + least, start[a], stop[z], origin[a], partners[a]])

    return run


def _places(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text_hash, word, anchor) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(2)):
                w = Words(c)
                at, h = w.windows(block)
                rows = pa.array(c.lo + w.row[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array((at - w.first[w.row[at]]).astype(np.int32)), pa.array(_short(h).view(np.int64))], names=["id", "text_hash", "word", "anchor"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, least: int = MIN_WORDS, most_anchors: int = ANCHORS, merged: bool = True, most_filtered: int = FILTERED) -> DataFrame:
    """(id, start_char, end_char, words, first_id) of every maximal span of words that occur elsewhere.

    A stretch of `least` words is repeated if its bytes, from its first word to its
    last, occur at another place of any row: 93 bits of two hashes stand for them. A span is a union of
    overlapping or touching repeated stretches, so each place of a longer repeat
    is whole. first_id is the smallest id that has the span's first stretch: the
    row's own id where nothing earlier has it. With merged=False a span ends where
    the documents that share its stretches change, and another begins, which
    overlaps it by less than `least` words: each repeated passage has a span and a
    first_id of its own. Characters count from 0, the end
    excluded. Texts of fewer words, empty and null ones have no spans. Repeated
    rows repeat each other wholly and share their spans. Rows with a null id are
    left out, as nothing could name them. Ids are integers; an id column with the name
    of a result's gets "_" after it. Other columns are ignored. An empty table gives
    no rows. least must be 2 * block - 1 at least.
    """
    if least < 2 * block - 1:
        raise ValueError("a repeat must be long enough to hold a whole block")
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    hot = written(anchors(rows, "text", block), "anchors")
    count = hot.count()
    if count <= most_anchors:
        found = _Anchors(block, least, spark.sparkContext.broadcast(Exact(hot.toPandas()["anchor"].to_numpy().astype(np.int64).view(U64))))
    elif count <= most_filtered:
        found = _Anchors(block, least, spark.sparkContext.broadcast(Filter.of(hot, count)))
    else:
        places = rows.mapInArrow(_places(block), "id long, text_hash long, word int, anchor long").join(hot, "anchor", "left_semi")
        lists = places.select("id", "text_hash", "word").distinct().groupBy("id", "text_hash").agg(F.array_sort(F.collect_list("word")).alias("places"))
        rows = written(rows.join(lists, ["id", "text_hash"]).select("id", "text_hash", "text", "places"), "anchored")
        found = _Anchors(block, least, None)
    heavy = spark.sparkContext.broadcast(_heavy(rows, found))
    keys_of = even_keys(spark, 3)
    sent = rows.mapInArrow(_stretches(found, keys_of, heavy, merged), _STRETCH)
    spans = sent.groupBy("bucket").applyInArrow(_agreeing(least, merged, frozenset(keys_of[len(keys_of) * 2 // 3 :].tolist())), _SPAN)
    same = ["id", "text_hash"] if merged else ["id", "text_hash", "first_id", "partners"]
    own = Window.partitionBy(*same).orderBy("word", "past")
    reach = F.max("past").over(own.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("_new", F.when(reach.isNull() | (F.col("word") > (reach if merged else reach - (least - 1))), 1).otherwise(0)).withColumn("_span", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = apart.groupBy(*same, "_span").agg(F.min("start").alias("start_char"), F.max("stop").alias("end_char"), (F.max("past") - F.min("word")).alias("words"), F.min(F.struct("word", F.col("first_id").alias("_first"))).alias("_least"))
    return spans.select(F.col("id").alias(free_name(id_col, "start_char", "end_char", "words", "first_id")), "start_char", "end_char", "words", F.col("_least._first").alias("first_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), merged=False)
