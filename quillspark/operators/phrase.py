"""Where terms lie in documents: positions, distances of neighbouring query terms, and ranking by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.index import Index

#: Positions of the first matches that a document keeps.
FIRST_MATCHES = 4


def match_positions(index: Index, keys: DataFrame, results: DataFrame) -> DataFrame:
    """(segment, doc_id, pos, len) of the keys (segment, term) in the documents of the results, each place once."""
    found = index.positions.join(keys.select("segment", "term").distinct(), ["segment", "term"], "left_semi")
    inside = found.join(results.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_semi")
    return inside.select("segment", "doc_id", "pos", F.length("term").alias("len"))


def pair_gaps(positions: DataFrame, terms: list[str]) -> DataFrame:
    """(segment, doc_id, pair, gap): for neighbours i and i + 1 of the terms, the least distance from one on to the other, null if there is none.

    Only documents with at least one of the terms have rows. The next place of
    the second term at or after each of the first one is found by one sort of a
    document's places, not by joining all with all.
    """
    out = None
    for i, (a, b) in enumerate(zip(terms, terms[1:], strict=False)):
        rows = positions.where(F.col("term").isin(a, b)).select("segment", "doc_id", "pos", (F.col("term") == a).alias("is_a"), (F.col("term") == b).alias("is_b"))
        after = Window.partitionBy("segment", "doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)  # backwards, so that each place is read once
        next_b = F.last(F.when(F.col("is_b"), F.col("pos")), ignorenulls=True).over(after)
        gaps = rows.withColumn("gap", F.when(F.col("is_a"), next_b - F.col("pos"))).groupBy("segment", "doc_id").agg(F.min("gap").alias("gap"))
        part = gaps.select("segment", "doc_id", F.lit(i).alias("pair"), "gap")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a phrase has two terms at least")
    return out


def scaler(difference: Column) -> Column:
    return F.when(difference <= 2, 100).when(difference <= 5, 50).when(difference <= 10, 25).when(difference <= 20, 10).otherwise(1)


def rerank(results: DataFrame, positions: DataFrame, terms: list[str]) -> DataFrame:
    """results (segment, doc_id, score) with difference and the score scaled up the nearer the terms follow each other.

    A pair adds how far its gap is from the first term's length plus one. A
    document in which some pair has no gap keeps its score, its difference null.
    """
    if len(terms) < 2:
        return results.withColumn("difference", F.lit(0).cast("long"))
    sizes = F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(i), F.lit(len(t) + 1))])
    near = pair_gaps(positions, terms).groupBy("segment", "doc_id").agg(
        F.sum(F.abs(F.col("gap") - sizes[F.col("pair")])).cast("long").alias("difference"), F.count("gap").alias("pairs")
    )
    joined = results.join(near, ["segment", "doc_id"], "left")
    whole = F.when(F.col("pairs") == len(terms) - 1, F.col("difference"))
    return joined.withColumn("difference", whole).select("segment", "doc_id", (F.col("score") * F.coalesce(scaler(F.col("difference")), F.lit(1))).alias("score"), "difference")


def first_matches(positions: DataFrame, most: int = FIRST_MATCHES) -> DataFrame:
    """(segment, doc_id, places): a document's first places, in their order."""
    order = Window.partitionBy("segment", "doc_id").orderBy("pos")
    first = positions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return first.groupBy("segment", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("places"))
