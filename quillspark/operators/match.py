"""Combining the scores of a query's terms: all of them, any, or any where all give nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What each term's score counts for when all terms are there.
ALL_FACTOR = 1.3

#: Documents taken whatever their score when segments' results are joined, and how far below the mean later ones may be.
JOIN_FIRST, JOIN_DIVISOR = 40, 1.2


def match_all(scores: DataFrame, terms: int) -> DataFrame:
    """(segment, doc_id, score) of the documents that have all of so many query terms.

    Of scores (segment, qpos, doc_id, score), any number of them for a term and
    document. A single term's scores stay; more are added up as doubles, that of
    the term with the fewest documents in the segment first, each with
    ALL_FACTOR, and cut to a whole number. One shuffle, by document.
    """
    sums = [F.sum(F.when(F.col("qpos") == i, F.col("score"))).alias(f"s{i}") for i in range(terms)]
    wide = scores.groupBy("segment", "doc_id").agg(*sums)
    if terms == 1:
        return wide.select("segment", "doc_id", F.col("s0").alias("score"))
    sizes = wide.groupBy("segment").agg(*[F.count(f"s{i}").alias(f"n{i}") for i in range(terms)])
    full = wide.where(" AND ".join(f"s{i} IS NOT NULL" for i in range(terms))).join(F.broadcast(sizes), "segment")  # a row a segment
    parts = F.array_sort(F.array(*[F.struct(F.col(f"n{i}").alias("size"), F.lit(i).alias("qpos"), F.col(f"s{i}").alias("score")) for i in range(terms)]))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x.getField("score").cast("double") * F.lit(ALL_FACTOR))
    return full.select("segment", "doc_id", total.cast("long").alias("score"))


def match_any(scores: DataFrame) -> DataFrame:
    """(segment, doc_id, score) of the documents that have any term; scores are added up."""
    return scores.groupBy("segment", "doc_id").agg(F.sum("score").alias("score"))


def match_all_or_any(scores: DataFrame, terms: int) -> DataFrame:
    """match_all(), and in segments where that is empty, match_any()."""
    every = match_all(scores, terms)
    if terms == 1:
        return every
    served = every.select("segment").distinct()
    return every.unionByName(match_any(scores).join(F.broadcast(served), "segment", "left_anti"))  # one row a segment


def best(results: DataFrame, limit: int = 20) -> DataFrame:
    """The documents with the highest scores; of equals those with the smaller id."""
    return results.orderBy(F.col("score").desc(), "doc_id").limit(limit)


def joined_segments(results: DataFrame, first: int = JOIN_FIRST) -> DataFrame:
    """Results of several segments, without those that lag behind the mean of what came before.

    Segments are taken by name, their documents from the best score down. From
    the `first` on, one needs the running mean of what was taken, in single
    precision, over JOIN_DIVISOR, cut to a whole number. As a segment's scores
    fall, once one is refused all the rest of it are: how far down each segment is
    taken follows from how many documents have each score, and only those numbers
    are walked in order.
    """

    def walk(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("segment", "score", "n")), strict=True), key=lambda r: (r[0], -r[1]))
        divisor = float(np.float32(JOIN_DIVISOR))
        taken, mean, shut, out = 0, np.float32(0), None, []
        for segment, score, n in rows:
            if segment == shut:
                continue
            for k in range(n):
                if taken >= first and score < int(np.float32(float(mean) / divisor)):
                    shut = segment
                    n = k
                    break
                total = np.float32(float(np.float32(taken * float(mean))) + score)
                taken += 1
                mean = np.float32(float(total) / taken)
            out.append((segment, score, n))
        least = {segment: (score, n) for segment, score, n in out}
        return pa.table({"segment": pa.array(list(least), pa.string()), "_least": pa.array([x for x, _ in least.values()], pa.int64()), "_last": pa.array([n for _, n in least.values()], pa.int64())})

    import pyarrow as pa

    counts = results.groupBy("segment", "score").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy().applyInArrow(walk, "segment string, _least long, _last long")
    held = results.join(F.broadcast(ends), "segment")  # a row a segment
    order = Window.partitionBy("segment").orderBy("doc_id")
    lowest = held.where(F.col("score") == F.col("_least")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("_last"))
    return held.where(F.col("score") > F.col("_least")).select("segment", "doc_id", "score").unionByName(lowest.select("segment", "doc_id", "score"))
