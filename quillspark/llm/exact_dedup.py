"""Exact deduplication by counting quotient filters.

Each partition puts the 64-bit fingerprints of its texts into counting quotient
filters, one per segment of the hash space. Filters of one segment are merged
without loss, as quotient and remainder together are the whole fingerprint.
Fingerprints counted more than once lead to a comparison of the texts' bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.kernels import U64, ranges
from quillspark.llm.runtime import free_name, small, written

#: Filters are built at most this full.
LOAD = 0.75


def cqf_build(fingerprints: np.ndarray, counts: np.ndarray, top_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct fingerprints that share their top bits.

    Layout: eight header bytes each for quotient bits, slots and counters; bit
    vectors of occupied quotients, of run ends and of slots with a counter;
    remainders slot by slot; counters. A slot without counter counts one.
    """
    n = len(fingerprints)
    q = max(1, int(np.ceil(np.log2(max(1, n) / LOAD))))
    rest = 64 - top_bits
    low = fingerprints & U64((1 << rest) - 1)
    r = rest - q
    quotient = (low >> U64(r)).astype(np.int64)
    remainder = low & U64((1 << r) - 1)
    step = np.arange(n)
    slot = np.maximum.accumulate(quotient - step) + step
    slots = max(1 << q, int(slot[-1]) + 1) if n else 1 << q
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    last = np.ones(n, dtype=bool)
    last[:-1] = quotient[1:] != quotient[:-1]
    run_end = np.zeros(slots, dtype=bool)
    run_end[slot[last]] = True
    many = counts > 1
    counted = np.zeros(slots, dtype=bool)
    counted[slot[many]] = True
    width = (r + 7) // 8
    cells = np.zeros((slots, 8), dtype=np.uint8)
    cells[slot] = remainder.astype("<u8").view(np.uint8).reshape(-1, 8)
    head = np.array([q, slots, int(many.sum())], dtype="<u8").tobytes()
    return b"".join([head, *(np.packbits(b).tobytes() for b in (occupied, run_end, counted)), cells[:, :width].tobytes(), counts[many].astype("<u8").tobytes()])


def cqf_read(data: bytes, top: int, top_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter, and their counts."""
    q, slots, many = (int(x) for x in np.frombuffer(data, "<u8", 3))
    at = 24
    bits = []
    for size in (1 << q, slots, slots):
        length = (size + 7) // 8
        bits.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at))[:size].astype(bool))
        at += length
    occupied, run_end, counted = bits
    r = 64 - top_bits - q
    width = (r + 7) // 8
    cells = np.zeros((slots, 8), dtype=np.uint8)
    cells[:, :width] = np.frombuffer(data, np.uint8, slots * width, at).reshape(slots, width)
    at += slots * width
    remainder = cells.reshape(-1).view("<u8").astype(U64)
    quotient = np.flatnonzero(occupied)
    end = np.flatnonzero(run_end)
    before = np.concatenate([[-1], end[:-1]]) if len(end) else end
    start = np.maximum(quotient, before + 1)
    slot = ranges(start, end - start + 1)
    count = np.ones(slots, dtype=np.int64)
    count[counted] = np.frombuffer(data, "<u8", many, at).astype(np.int64)
    prefix = U64((top << (64 - top_bits)) & (2**64 - 1)) if top_bits else U64(0)
    quotients = np.repeat(quotient, end - start + 1).astype(U64)
    return prefix | (quotients << U64(r)) | remainder[slot], count[slot]


def _both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of remainders, with their quotients before them, as one; counts of equal ones are added."""
    at = np.searchsorted(a[0], b[0])
    keys, counts = np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def cqf_merge(filters: list[bytes], top: int, top_bits: int) -> bytes:
    """One filter of several of a segment, by merging their sorted runs two by two."""
    runs = [cqf_read(f, top, top_bits) for f in filters]
    while len(runs) > 1:
        runs = [_both(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return cqf_build(*runs[0], top_bits)


def _segments(top_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for b in batches if b.num_rows]
        if not seen:
            return
        keys, counts = np.unique(np.concatenate(seen), return_counts=True)
        tops = (keys >> U64(64 - top_bits)).astype(np.int64) if top_bits else np.zeros(len(keys), np.int64)
        found, starts = np.unique(tops, return_index=True)
        ends = np.append(starts[1:], len(keys))
        filters = [cqf_build(keys[a:b], counts[a:b], top_bits) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(filters, pa.binary())], names=["segment", "filter"])

    return build


def _merged(top_bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        top = key[0].as_py()
        keys, counts = cqf_read(cqf_merge(table.column("filter").to_pylist(), top, top_bits), top, top_bits)
        twice = counts > 1
        return pa.table({"_fp": pa.array(keys[twice].view(np.int64)), "_count": pa.array(counts[twice])})

    return merge


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(_fp, _count) of the fingerprints, in the one column given, that occur more than once."""
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top_bits = max(1, int(np.ceil(np.log2(4 * parts))))
    filters = fingerprints.mapInArrow(_segments(top_bits), "segment long, filter binary")
    return filters.groupBy("segment").applyInArrow(_merged(top_bits), "_fp long, _count long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _fp, _keep, _copies, _own) in groups of equal texts, and the same with _text for fingerprints of several texts.

    _keep is the group's smallest id, _copies its rows, _own the rows with that
    id. The second table is empty unless different texts share a fingerprint.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    keyed = base.withColumn("_fp", fingerprint(F.col("_text")))
    twice = written(repeated_fingerprints(keyed.select("_fp")), "fingerprints")
    suspects = keyed.join(small(twice.select("_fp")), "_fp", "left_semi")
    texts = written(suspects.groupBy("_fp", "_text").agg(F.count(F.lit(1)).alias("_n")).groupBy("_fp").agg(F.count(F.lit(1)).alias("_texts")), "compared")
    clear, mixed = texts.where("_texts = 1").select("_fp"), texts.where("_texts > 1").select("_fp")

    def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
        by_id = rows.groupBy(*keys, "_id").agg(F.count(F.lit(1)).alias("_rows"))
        least = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_rows").alias("rows")))
        return by_id.groupBy(*keys).agg(least.alias("_least"), F.sum("_rows").alias("_copies")).where("_copies > 1").select(*keys, F.col("_least.id").alias("_keep"), F.col("_least.rows").alias("_own"), "_copies")

    ids = keyed.select("_id", "_fp")
    one = ids.join(small(clear), "_fp", "left_semi")
    single = summed(one, ["_fp"])
    several = summed(keyed.join(small(mixed), "_fp", "left_semi"), ["_fp", "_text"])
    return written(single, "groups"), written(several, "groups-of-texts")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For every row: id, keep_id, copies, is_duplicate.

    keep_id is the smallest id among the rows with the same text, copies their
    number, is_duplicate whether another id is kept. Empty texts equal each
    other. A null text equals nothing: its row keeps itself. Null ids come after
    all others; a group of null ids only has a null keep_id and no duplicate.
    Repeated rows count as copies. An id column with the name of a result's gets "_"
    after it. Other columns are ignored. An empty table
    gives no rows.
    """
    single, several = groups(docs, id_col, text_col, fingerprint)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_fp", F.when(F.col("_text").isNotNull(), fingerprint(F.col("_text"))))
    found = ["_id", "_keep", "_copies"]
    if several.take(1):
        mixed = several.select("_fp").distinct()
        apart = rows.join(small(mixed), "_fp", "left_semi").join(several, ["_fp", "_text"], "left").select(found)
        plain = rows.join(small(mixed), "_fp", "left_anti").drop("_text").join(small(single), "_fp", "left").select(found)
        both = plain.unionByName(apart)
    else:
        both = rows.drop("_text").join(small(single), "_fp", "left").select(found)
    keep = F.when(F.col("_copies").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return both.select(F.col("_id").alias(free_name(id_col, "keep_id", "copies", "is_duplicate")), keep.alias("keep_id"), F.coalesce("_copies", F.lit(1)).cast("long").alias("copies"), F.coalesce(~F.col("_id").eqNullSafe(keep), F.lit(False)).alias("is_duplicate"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """docs with one row left of each group of equal texts: the one with the smallest id.

    All columns stay as they are, whatever their names. Rows with null text
    stay. Of repeated rows with the group's smallest id, one stays.
    """
    single, several = groups(docs, id_col, text_col, fingerprint)
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_fp", F.when(F.col("_text").isNotNull(), fingerprint(F.col("_text"))))

    def kept(part: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
        joined = part.join(small(table), keys, "left").where(F.col("_copies").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
        once = joined.where(F.col("_own").isNull() | (F.col("_own") == 1)).select("_row")
        if table.where("_own > 1").take(1):
            once = once.unionByName(joined.where("_own > 1").dropDuplicates(["_fp", "_text"]).select("_row"))
        return once

    if several.take(1):
        mixed = several.select("_fp").distinct()
        out = kept(rows.join(small(mixed), "_fp", "left_anti"), single, ["_fp"]).unionByName(kept(rows.join(small(mixed), "_fp", "left_semi"), several, ["_fp", "_text"]))
    else:
        out = kept(rows, single, ["_fp"])
    return out.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, keep_id, copies, coalesce(doc_id IS DISTINCT FROM keep_id, false) AS is_duplicate
FROM (SELECT doc_id,
             CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
             CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies
      FROM documents)
"""
