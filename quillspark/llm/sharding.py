"""Consistent hashing with virtual nodes and bounded loads.

Each shard has many points on a ring; a key belongs to the first point at or
after its hash. No shard takes more than its bound: keys that come to a full
shard go on clockwise. Keys are taken in the order of their hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.kernels import U64, mix64
from quillspark.llm.runtime import free_name, written


#: Parts in which the rows of a key are numbered that has a large share of all.
SALTS = 64


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places (63 bits) of all virtual nodes, and the shard of each."""
    shard = np.repeat(np.arange(shards, dtype=U64), points)
    replica = np.tile(np.arange(points, dtype=U64), shards)
    place = (mix64((shard << U64(32)) | replica) >> U64(1)).astype(np.int64)
    order = np.lexsort((shard, place))
    return place[order], shard[order].astype(np.int64)


def pieces(counts: dict[int, int], owner: np.ndarray, bound: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, steps) that place every key of every arc.

    Arcs are filled in ring order; what a full shard can't take goes on to the
    next point clockwise.
    """
    left = np.full(int(owner.max()) + 1, bound, dtype=np.int64)
    total, out = len(owner), []
    for arc in sorted(counts):
        first, last, steps, seen, at = 1, counts[arc], 0, set(), arc
        while first <= last:
            shard = int(owner[at % total])
            if shard not in seen:
                seen.add(shard)
                take = min(last - first + 1, int(left[shard]))
                if take:
                    left[shard] -= take
                    out.append((arc, first, first + take - 1, shard, steps))
                    first += take
                steps += 1
            at += 1
    return out


def bound_of(keys: int, shards: int, slack: float) -> int:
    return max(1, math.ceil((1 + slack) * keys / shards))


def _often(share: float):
    """Hashes with a share of a task's rows, and how many rows it has (under -1): what has such a share of all has it in some task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) for b in batches if b.num_rows]
        if seen:
            keys, n = np.unique(np.concatenate(seen), return_counts=True)
            on = n >= max(2, share * n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[on], -1)), pa.array(np.append(n[on], n.sum()))], names=["hash", "n"])

    return run


def assign_shards(docs: DataFrame, key_col: str = "doc_id", shards: int = 64, points: int = 128, slack: float = 0.05, salts: int = SALTS) -> DataFrame:
    """For every row: key, home_shard, shard, steps.

    home_shard owns the key's place on the ring; steps counts the full shards
    that it passed. No shard has more than ceil((1 + slack) * rows / shards)
    rows. Keys are ordered by (hash, key); repeated keys each take a place of
    their own, so one key may lie on two shards where a bound falls between. The
    rows of a key with as large a share as a virtual node's are numbered in `salts`
    parts. A null key has a place as any other. A key column with the name of a
    result's gets "_" after it. Other columns are ignored. An empty table gives no
    rows.
    """
    places, owner = ring(shards, points)
    share = 1 / len(places)
    kind = docs.schema[key_col].dataType.simpleString()
    hashed = docs.select(F.col(key_col).alias("_key"), F.xxhash64(F.col(key_col)).bitwiseAND(2**63 - 1).alias("_hash"))
    often = written(hashed.select("_hash").mapInArrow(_often(share), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "often")
    total = (often.where("hash = -1").select("n").first() or (0,))[0]
    heavy = np.array(sorted(r[0] for r in often.where((F.col("hash") >= 0) & (F.col("n") >= max(2, share * total))).select("hash").collect()), dtype=np.int64)  # no more than virtual nodes

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            arc = np.searchsorted(places, h, side="left") % len(places)
            at = np.searchsorted(heavy, h, side="left")
            hit = heavy[np.minimum(at, len(heavy) - 1)] == h if len(heavy) else np.zeros(len(h), dtype=bool)
            salt = np.where(hit, (count + np.arange(len(h))) % salts, 0)
            count += len(h)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int32()) for x in (arc, 2 * at + hit, salt))], names=["_key", "_hash", "_arc", "_stretch", "_salt"])

    located = hashed.mapInArrow(locate, f"_key {kind}, _hash long, _arc int, _stretch int, _salt int")
    parts = ["_arc", "_stretch", "_salt"]
    counts: dict[int, int] = {}
    offsets = []
    for *part, n in sorted(located.groupBy(*parts).count().collect()):  # a row a virtual node, and two and `salts` a heavy key, at most
        offsets.append((*part, counts.get(part[0], 0)))
        counts[part[0]] = counts.get(part[0], 0) + n
    where = pieces(counts, owner, bound_of(sum(counts.values()), shards, slack)) if counts else []
    spark = docs.sparkSession
    table = spark.createDataFrame([(*w, int(owner[w[0]])) for w in where], "_at int, _first long, _last long, shard int, steps int, _home int")
    before = spark.createDataFrame(offsets, "_arc int, _stretch int, _salt int, _before long")
    ranked = located.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy("_hash", "_key"))).join(F.broadcast(before), parts).withColumn("_rank", F.col("_n") + F.col("_before"))
    placed = ranked.join(F.broadcast(table), (F.col("_arc") == F.col("_at")) & F.col("_rank").between(F.col("_first"), F.col("_last")))  # some rows a virtual node
    return placed.select(F.col("_key").alias(free_name(key_col, "home_shard", "shard", "steps")), F.col("_home").alias("home_shard"), "shard", "steps")


def query(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
