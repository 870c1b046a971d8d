"""Language-model scoring by prediction by partial matching (PPM).

A trie of byte contexts, up to ORDER bytes deep, holds how often each byte
follows each context in the texts that a model is fitted on. A byte is coded in
the deepest context that has seen it; each context that has not costs an escape
(method C: as likely as the context has different bytes), and the bytes it has
seen are excluded from what comes after. A model is the whole trie, which stays
dealt out in buckets: contexts that share their two nearest bytes are together, so
each bucket gives the bits of the codes, bytes with their contexts, that occur in
the texts to be scored. The bits of the SENT most frequent codes go to every task;
places of all others go to the tasks that have their bits.

A table is scored by models of its own texts as well: those of one half, by a hash
of the text, are coded by the model of the other half, so that no document, nor a
copy of it, is in the model that codes it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.kernels import U64, Chunk, HashTable, chunks, mix64, ranges
from quillspark.llm.runtime import free_name, written
from quillspark.llm.substring_dedup import from_planes, planes

#: Bytes of context, 2 to 4.
ORDER = 4

#: Nodes, each a context and a byte after it, that a model may have above single bytes of context: all, unless fewer are asked for.
NODES = math.inf

#: Codes of each part whose bits every task has.
SENT = 1 << 20

#: Places of other codes that a task adds up at a time, about.
_PLACES = 1 << 20

#: Counts that a task gathers before it adds them up.
_HELD = 1 << 22

#: Above the bits of a code: its number of context bytes in a model, its part in a count.
_LEVEL = U64(40)
_CODE = U64((1 << 40) - 1)


def grams(c: Chunk, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte with its context, the nearest byte first and the coded one last; and each row's number of them.

    Every row is preceded by zero bytes.
    """
    size = np.diff(c.bounds)
    at = ranges(c.bounds[:-1] + order * np.arange(1, c.rows + 1), size)
    data = np.zeros(len(c.data) + order * c.rows, dtype=U64)
    data[at] = c.data
    code = data.copy()
    for back in range(1, order + 1):
        code[back:] |= data[: len(data) - back] << U64(8 * (order - back + 1))
    return code[at], size


def counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sum of their counts."""
    if counts is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _counts(order: int, buckets: int):
    """Each task's counts of codes, tagged with their part, packed by bucket; contexts that share their two nearest bytes share a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        some = 0
        for b in batches:
            part = b.column(1).to_numpy(zero_copy_only=False).astype(U64)
            for c in chunks(b.column(0)):
                codes, size = grams(c, order)
                held.append(counted(codes | np.repeat(part[c.lo : c.hi] << _LEVEL, size)))
                some += len(held[-1][0])
                if some > _HELD:
                    held = [counted(*map(np.concatenate, zip(*held, strict=True)))]
                    some = len(held[0][0])
        if not some:
            return
        codes, counts = counted(*map(np.concatenate, zip(*held, strict=True)))
        bucket = (mix64((codes & _CODE) >> U64(8 * (order - 1))) % U64(buckets)).astype(np.int64)
        place = np.argsort(bucket, kind="stable")
        codes, counts, bucket = codes[place], counts[place].astype(np.int64), bucket[place]
        used, first = np.unique(bucket, return_index=True)
        cells = [[planes(x[lo:hi]) for lo, hi in zip(first, np.append(first[1:], len(bucket)), strict=True)] for x in (codes, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(x, pa.binary()) for x in cells)], names=["bucket", "codes", "counts"])

    return run


_TRIE = "bucket int, codes binary, counts binary"


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    codes = np.concatenate([from_planes(x, np.uint64) for x in table.column("codes").to_pylist()])
    counts = np.concatenate([from_planes(x, np.int64) for x in table.column("counts").to_pylist()])
    codes, counts = counted(codes, counts)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "codes": pa.array([planes(codes)], pa.binary()), "counts": pa.array([planes(counts)], pa.binary())})


def _buckets(spark: SparkSession) -> int:
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def context_trie(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, codes, counts) of all contexts of `order` bytes in (text, part); shorter contexts are their prefixes."""
    return texts.mapInArrow(_counts(order, buckets), _TRIE).groupBy("bucket").applyInArrow(_merge, _TRIE)


def _levels(codes: np.ndarray, counts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Codes and counts with ever fewer bytes of context, down to two."""
    for level in range(order, 1, -1):
        yield level, codes, counts
        codes, counts = counted((codes >> U64(16) << U64(8)) | (codes & U64(255)), counts)


#: Ranks that counts up to 2^63 may have.
_RANKS = 4608


def _rank(counts: np.ndarray) -> np.ndarray:
    """A count's place in a histogram: itself up to 4096, then eight steps a doubling."""
    return np.where(counts < 4096, counts, 4096 + np.floor(8 * (np.log2(np.maximum(counts, 4096)) - 12)).astype(np.int64))


#: The greatest count of each rank, about.
_UPPER = np.concatenate([np.arange(4096.0), 2.0 ** (12 + np.arange(1, _RANKS - 4095) / 8)])


def _cells(b: pa.RecordBatch, parts: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Each part's codes and counts, bucket by bucket."""
    for x, n in zip(*(b.column(k).to_pylist() for k in ("codes", "counts")), strict=True):
        codes, counts = from_planes(x, np.uint64), from_planes(n, np.int64)
        at = np.searchsorted(codes, np.arange(parts + 1).astype(U64) << _LEVEL)
        yield [(codes[lo:hi] & _CODE, counts[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _near(trie: DataFrame, order: int, parts: int) -> np.ndarray:
    """How often each byte follows each single byte, in each part: 256 x 256 numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts << 16, dtype=np.int64)
        for b in batches:
            for cells in _cells(b, parts):
                for part, (codes, counts) in enumerate(cells):
                    np.add.at(total, (part << 16) + ((codes >> U64(8 * order) << U64(8)) | (codes & U64(255))).astype(np.int64), counts)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["pair", "n"])

    out = np.zeros(parts << 16, dtype=np.int64)
    for pair, n in trie.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[pair] = n
    return out.reshape(parts, 256, 256)


def _ranks(trie: DataFrame, order: int, parts: int, shorter: bool) -> np.ndarray:
    """For each part how many nodes, those of shorter contexts too or not, have a count of each rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, _RANKS), dtype=np.int64)
        for b in batches:
            for cells in _cells(b, parts):
                for part, (codes, counts) in enumerate(cells):
                    for n in (n for _, _, n in _levels(codes, counts, order)) if shorter else (counts,):
                        total[part] += np.bincount(_rank(n), minlength=_RANKS)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total.ravel()[on])], names=["rank", "n"])

    total = np.zeros(parts * _RANKS, dtype=np.int64)
    for rank, n in trie.mapInArrow(run, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect():  # _RANKS a part at most
        total[rank] = n
    return total.reshape(parts, -1)


def _least(ranks: np.ndarray, most: float) -> list[int]:
    """For each part the least rank from which on there are `most` nodes at most."""
    above = np.cumsum(ranks[:, ::-1], axis=1)[:, ::-1]
    return [int(np.flatnonzero(np.append(row, 0) <= most)[0]) for row in above]


@dataclass
class Nodes:
    """Nodes and contexts of a bucket of a trie, each under the number of its context bytes, and the counts after single bytes.

    A context has the sum of its counts, its number of bytes, and the sum of what
    those bytes count in the next shorter context.
    """

    order: int
    node: np.ndarray
    count: np.ndarray
    context: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    below: np.ndarray
    near: np.ndarray


def _nodes(order: int, codes: np.ndarray, counts: np.ndarray, near: np.ndarray, least: int) -> Nodes:
    """The nodes and contexts of a bucket, of those that count enough."""
    kept = [(level, keys[on], n[on]) for level, keys, n in _levels(codes, counts, order) for on in [_rank(n) >= least]]
    out: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in (U64, np.int64, U64, np.int64, np.int64, np.int64)]
    for k, (level, keys, n) in enumerate(kept):
        if not len(keys):
            continue
        context = keys >> U64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        if level > 2:
            _, shorter, m = kept[k + 1]
            below = m[np.searchsorted(shorter, (keys >> U64(16) << U64(8)) | (keys & U64(255)))]
        else:
            below = near[(keys >> U64(16)).astype(np.int64), (keys & U64(255)).astype(np.int64)]
        tag = U64(level) << _LEVEL
        sums = tag | keys, n, tag | context[first], np.add.reduceat(n, first), np.diff(np.append(first, len(keys))), np.add.reduceat(below, first)
        for x, y in zip(out, sums, strict=True):
            x.append(y)
    return Nodes(order, *map(np.concatenate, out), near)


@dataclass
class Model:
    """A trie, as a table in the shared folder; the counts after single bytes and the least rank of counts that is kept, for each part."""

    order: int
    buckets: int
    trie: DataFrame
    near: np.ndarray
    least: list[int]


def fit_parts(texts: DataFrame, parts: int, order: int = ORDER, nodes: float = NODES) -> Model:
    """Models of all parts of the texts, in (text, part); null texts are in none."""
    if not 2 <= order <= 4:
        raise ValueError("contexts of 2 to 4 bytes")
    buckets = _buckets(texts.sparkSession)
    trie = written(context_trie(texts, order, buckets), "trie")
    least = [0] * parts if nodes == math.inf else _least(_ranks(trie, order, parts, True), nodes)
    return Model(order, buckets, trie, _near(trie, order, parts), least)


def fit(texts: DataFrame, text_col: str = "text", order: int = ORDER, nodes: float = NODES) -> Model:
    """A model of all texts of a table, to score others by."""
    return fit_parts(texts.select(F.col(text_col), F.lit(0).alias("_part")), 1, order, nodes)


class Coder:
    """A model made ready to code texts."""

    def __init__(self, m: Nodes) -> None:
        self.order, self.near = m.order, m.near
        self.nodes, self.contexts = HashTable(m.node), HashTable(m.context)
        self.count, self.total, self.kinds, self.below = (x.astype(np.float64) for x in (m.count, m.total, m.kinds, m.below))
        self.whole = np.zeros(len(m.node))
        top = np.flatnonzero(m.node >> _LEVEL == m.order)
        if len(top):
            at = self.contexts.find((U64(m.order) << _LEVEL) | ((m.node[top] & U64((1 << 40) - 1)) >> U64(8)))
            self.whole[top] = np.log2((self.total[at] + self.kinds[at]) / self.count[top])

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits for each byte, given with its context."""
        order = self.order
        at = self.nodes.find((U64(order) << _LEVEL) | codes)
        out = np.where(at >= 0, self.whole[at] if len(self.whole) else 0.0, 0.0)
        left = np.flatnonzero(at < 0)
        excluded = np.zeros(len(left))  # counts on this level, and number, of the bytes that a longer context has seen
        seen = np.zeros(len(left))
        for level in range(order, -1, -1):
            if not len(left):
                return out
            context = codes[left] >> U64(8 * (order - level + 1))
            byte = codes[left] & U64(255)
            if level >= 2:
                tag = U64(level) << _LEVEL
                node = self.nodes.find(tag | context << U64(8) | byte) if level < order else np.full(len(left), -1)
                place = self.contexts.find(tag | context)
                known = place >= 0
                own = np.where(node >= 0, self.count[node], 0.0) if len(self.count) else np.zeros(len(left))
                total, kinds, below = (np.where(known, x[place], 0.0) if len(x) else np.zeros(len(left)) for x in (self.total, self.kinds, self.below))
            else:
                table = self.near if level else self.near.sum(axis=0, keepdims=True)
                row = context.astype(np.int64) if level else np.zeros(len(left), np.int64)
                own = table[row, byte.astype(np.int64)].astype(np.float64)
                total, kinds = table.sum(axis=1)[row], (table > 0).sum(axis=1)[row]
                below = ((self.near > 0) @ self.near.sum(axis=0))[row] if level else np.zeros(len(left))
            room = total - excluded + kinds - seen
            hit = own > 0
            out[left[hit]] += np.log2(room[hit] / own[hit])
            go = np.flatnonzero(~hit)
            escapes = go[kinds[go] > seen[go]]
            out[left[escapes]] += np.log2(room[escapes] / (kinds[escapes] - seen[escapes]))
            left, excluded, seen = left[go], below[go].astype(np.float64), kinds[go].astype(np.float64)
        out[left] += np.log2(256 - seen)
        return out


_COSTS = "sent boolean, codes binary, bits binary"


def _costs(m: Model, trie: DataFrame, by: dict[int, int], sent: list[int]) -> DataFrame:
    """Bits of the codes of each part in `by`, by the model of the part named there; codes with a rank from `sent` on apart from others."""
    order, near, least = m.order, m.near, m.least
    parts = 1 + max(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cells in _cells(b, parts):
                for part, model in by.items():
                    codes, counts = cells[part]
                    if not len(codes):
                        continue
                    bits = Coder(_nodes(order, *cells[model], near[model], least[model])).bits(codes)
                    often = _rank(counts) >= sent[part]
                    tagged = codes | U64(part) << _LEVEL
                    rows = [(on, x, y) for on, where in ((True, often), (False, ~often)) if where.any() for x, y in [(planes(tagged[where]), bits[where].tobytes())]]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), (pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["sent", "codes", "bits"])

    return trie.mapInArrow(run, _COSTS)


_NAMES = ["_id", "key", "_bytes", "_bits", "bucket", "known", "codes", "cells"]

_TABLES: dict[str, tuple[HashTable, np.ndarray]] = {}


def _table(name: str, sent: tuple[np.ndarray, np.ndarray]) -> tuple[HashTable, np.ndarray]:
    """A worker's table of bits, made once; those of other queries go."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = HashTable(sent[0]), sent[1]
    return _TABLES[name]


def _dealt(codes: np.ndarray, cells: tuple[np.ndarray, ...], into: int) -> Iterator[tuple[int, list[bytes]]]:
    """Places by a hash of their codes."""
    bucket = (mix64(codes) % U64(into)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True):
        yield int(bucket[lo]), [x[order[lo:hi]].tobytes() for x in (codes, *cells)]


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of bits by row: places, as (codes, rows), and the bits of their codes, as (codes, bits)."""
    known, places = (table.filter(table.column("known") if on else pa.compute.invert(table.column("known"))) for on in (True, False))
    codes, bits, at, row = (np.frombuffer(b"".join(t.column(k).to_pylist()), kind) for t, k, kind in ((known, "codes", U64), (known, "cells", np.float64), (places, "codes", U64), (places, "cells", np.int64)))
    order = np.argsort(codes)
    row, where = np.unique(row, return_inverse=True)
    total = np.bincount(where, weights=bits[order[np.searchsorted(codes, at, sorter=order)]], minlength=len(row)) if len(at) else np.zeros(0)
    return pa.table({"key": pa.array(row, pa.int64()), "rest": pa.array(total, pa.float64())})


def _sums(c: Chunk, each: np.ndarray) -> np.ndarray:
    out = np.zeros(c.rows)
    some = np.flatnonzero(np.diff(c.bounds))
    if len(some):
        out[some] = np.add.reduceat(each, c.bounds[some])
    return out


def _scored(docs: DataFrame, m: Model, trie: DataFrame, by: dict[int, int], part: Column, id_col: str, text_col: str, sent: int) -> DataFrame:
    """Each row's code length, by the model that codes its part."""
    spark, order = docs.sparkSession, m.order
    ranks = _ranks(trie, order, 1 + max(by), False)
    least = _least(ranks, sent)
    costs = _costs(m, trie, by, least)
    rest = sum(float(ranks[p, : least[p]] @ _UPPER[: least[p]]) for p in by)
    if rest:
        costs = written(costs, "costs")
    found = costs.where("sent").select("codes", "bits").toArrow()  # SENT a part at most
    codes = np.concatenate([np.zeros(0, U64), *(from_planes(x, np.uint64) for x in found.column("codes").to_pylist())])
    every = spark.sparkContext.broadcast((codes, np.frombuffer(b"".join(found.column("bits").to_pylist()), np.float64)))
    into = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rest) // _PLACES)
    kind = docs.schema[id_col].dataType
    kinds = f"_id {kind.simpleString()}, key long, _bytes long, _bits double, bucket long, known boolean, codes binary, cells binary"
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits_of = _table(name, every.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        like = None

        def given() -> Iterator[pa.RecordBatch]:
            codes, rows = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            dealt = list(_dealt(codes, (rows,), into))
            n = len(dealt)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, like), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64())), pa.array([k for k, _ in dealt], pa.int64()), pa.array([False] * n), *(pa.array([x[k] for _, x in dealt], pa.binary()) for k in range(2))], names=_NAMES)

        for b in batches:
            like = b.column(0).type
            own, key = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            size, total, none = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
            for c in chunks(b.column(1)):
                codes, n = grams(c, order)
                codes |= np.repeat(own[c.lo : c.hi].astype(U64) << _LEVEL, n)
                at = table.find(codes)
                bits = np.zeros(len(codes))
                on = at >= 0
                bits[on] = bits_of[at[on]]
                if not on.all():
                    held.append((codes[~on], np.repeat(key[c.lo : c.hi], n)[~on]))
                total.append(_sums(c, bits))
                size.append(n)
                none.append(~c.valid)
                if sum(len(x) for x, _ in held) > _PLACES:
                    yield from given()
            mask = np.concatenate(none)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(np.concatenate(size), mask=mask), pa.array(np.concatenate(total), mask=mask), *(pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=_NAMES)
        if held:
            yield from given()

    def bits_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column("codes").to_pylist(), b.column("bits").to_pylist(), strict=True):
                dealt = list(_dealt(from_planes(x, np.uint64), (np.frombuffer(y, np.float64),), into))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int64()), pa.array([True] * len(dealt)), *(pa.array([x[k] for _, x in dealt], pa.binary()) for k in range(2))], names=_NAMES[4:])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), part.cast("int").alias("_part"), F.monotonically_increasing_id().alias("_key"))
    scored = rows.mapInArrow(run, kinds)
    if rest:
        scored = written(scored, "scored")  # the keys of rows must not change from here on
        dealt = "bucket long, known boolean, codes binary, cells binary"
        places = scored.where("bucket IS NOT NULL").select(*_NAMES[4:]).unionByName(costs.where("NOT sent").select("codes", "bits").mapInArrow(bits_dealt, dealt))
        more = places.groupBy("bucket").applyInArrow(_added, "key long, rest double").groupBy("key").agg(F.sum("rest").alias("rest"))
        scored = scored.where("bucket IS NULL").join(more, "key", "left").withColumn("_bits", F.col("_bits") + F.coalesce("rest", F.lit(0.0)))
    share = F.when(F.col("_bytes") == 0, 0.0).otherwise(F.round(F.col("_bits") / F.col("_bytes"), 6))
    name_of = free_name(id_col, "n_bytes", "code_length", "bits_per_byte")
    return scored.select(F.col("_id").alias(name_of), F.col("_bytes").alias("n_bytes"), F.round("_bits", 3).alias("code_length"), share.alias("bits_per_byte"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """What score_documents() gives, by a model fitted before, on whatever texts."""
    own = docs.select(F.col(text_col), F.lit(1).alias("_part")).mapInArrow(_counts(model.order, model.buckets), _TRIE)
    both = written(own.unionByName(model.trie).groupBy("bucket").applyInArrow(_merge, _TRIE), "tries")
    return _scored(docs, model, both, {1: 0}, F.lit(1), id_col, text_col, sent)


def score_documents(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", nodes: float = NODES, sent: int = SENT) -> DataFrame:
    """For every row: id, n_bytes, code_length, bits_per_byte, each half of the texts by a model of the other half.

    The half is the parity of the text's hash, so equal texts have equal results.
    code_length is the text's length in bits under the model described above,
    rounded to 3 decimals, bits_per_byte its share of a byte: 8 where the other half
    has no text. An empty text has 0 bytes, bits and bits per byte; a null one
    nulls, and neither adds to a model. Repeated rows count each, both in the model
    and in the result, null ids are reported as null. An id column with the name of a
    result's gets "_" after it. Other columns are ignored. An empty table gives no
    rows. Where fewer nodes are asked for, a model has the most frequent ones; by
    default it has all. What is `sent` to every task doesn't change the result.
    """
    half = F.coalesce(F.pmod(F.xxhash64(F.col(text_col)), F.lit(2)), F.lit(0)).cast("int")
    model = fit_parts(docs.select(F.col(text_col), half.alias("_part")), 2, order, nodes)
    return _scored(docs, model, model.trie, {0: 1, 1: 0}, half, id_col, text_col, sent)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
