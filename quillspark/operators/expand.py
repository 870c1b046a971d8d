"""From query terms to the index terms that answer them, and to scores of documents."""

from __future__ import annotations

import bisect
import math
import struct
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators.index import Index
from quillspark.storage import held, local_rows

#: Stubs that a session keeps of an index, and terms that it looks at for a query, on the driver; beyond, plans do it.
STUBS, SCANNED = 1 << 20, 20_000

#: Keys of at least this score count for positions, besides exact ones.
POSITION_SCORE = 20


def query_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(qpos, q, qkey) of the terms of a query, in their order."""
    if not terms:
        raise ValueError("a query needs at least one term")
    rows = local_rows(spark, list(enumerate(terms)), "qpos int, q string")
    return rows.withColumn("qkey", T.term_key(F.col("q")))


def window_bounds(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(segment, qpos, q, first_ord, first_key, end_key): where the scan of a segment's terms for each query term begins and with which key it ends.

    Bounds are taken from every tenth term: the last one under the query's key
    less a step on the fifth letter (or the first at all), and the first one
    above the key plus a step (or the last at all). Nothing is scanned where no
    such term reaches the lower bound.
    """
    stubs = terms.where("is_stub").select("segment", "term_ord", "k27")
    pairs = stubs.crossJoin(F.broadcast(queries))  # as many rows as the query has terms
    low, high = F.col("qkey") - T.KEY_STEP, F.col("qkey") + T.KEY_STEP
    under, over = F.col("k27") < low, F.col("k27") > high
    found = pairs.groupBy("segment", "qpos", "q").agg(
        F.coalesce(F.max(F.when(under, F.col("term_ord"))), F.min("term_ord")).alias("first_ord"),
        F.coalesce(F.max(F.when(under, F.col("k27"))), F.min("k27")).alias("first_key"),
        F.coalesce(F.min(F.when(over, F.col("k27"))), F.max("k27")).alias("end_key"),
        F.max((F.col("k27") >= low).cast("int")).alias("reached"),
    )
    return found.where("reached = 1").drop("reached")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _narrowed(table: DataFrame, column: str, spans: list[tuple[str, object, object]]) -> DataFrame:
    """The table's rows in some segment and range of a column: both conditions reach the scan."""
    ranges = sorted({(a, b) for _, a, b in spans})
    segments = sorted({s for s, _, _ in spans})
    return table.where(F.col("segment").isin(*segments) & _any([F.col(column).between(a, b) for a, b in ranges])) if spans else table.limit(0)


def scanned_terms(index: Index, queries: DataFrame, window: str = "stub") -> DataFrame:
    """(segment, qpos, q, term, term_ord, score) of the terms that are compared with each query term.

    window 'stub' scans between the bounds of window_bounds(), up to the first
    term with the end's key; 'prefix' takes all terms that begin with the query.
    """
    terms = index.terms
    if window == "prefix":
        pairs = terms.join(F.broadcast(queries), F.col("term").startswith(F.col("q")))
        return pairs.select("segment", "qpos", "q", "term", "term_ord", T.match_score(F.col("q"), F.col("term")).alias("score"))
    if window != "stub":
        raise ValueError(f"no such window: {window}")
    bounds, rows = held(window_bounds(terms, queries))
    if rows is not None:
        terms = _narrowed(terms, "k27", [(r.segment, r.first_key, r.end_key) for r in rows])
    inside = (F.col("t.segment") == F.col("b.segment")) & (F.col("t.term_ord") >= F.col("b.first_ord")) & (F.col("t.k27") <= F.col("b.end_key"))
    pairs = terms.select("segment", "term", "term_ord", "k27").alias("t").join(F.broadcast(bounds).alias("b"), inside)  # a row a segment and query term
    first = Window.partitionBy("segment", "qpos").orderBy("term_ord")
    ended = F.sum((F.col("k27") == F.col("end_key")).cast("int")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    scan = pairs.select(F.col("t.segment").alias("segment"), "qpos", "q", "term", "term_ord", "k27", "end_key").withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0")
    return scan.select("segment", "qpos", "q", "term", "term_ord", T.match_score(F.col("q"), F.col("term")).alias("score"))


def expanded_terms(index: Index, queries: DataFrame, window: str = "stub") -> DataFrame:
    """(segment, qpos, q, term, score) of the accepted terms: in order of the alphabet, each must reach the cutoff of the moment."""
    scored = scanned_terms(index, queries, window)
    # a score below the first cutoff is never accepted, as the cutoff never falls under it
    lists = scored.where(F.col("score") >= F.lit(T.FIRST_CUTOFF)).groupBy("segment", "qpos", "q").agg(F.collect_list(F.struct("term_ord", "term", "score")).alias("keys"))
    kept = lists.select("segment", "qpos", "q", F.explode(T.accepted_keys(F.col("keys"))).alias("k"))
    return kept.select("segment", "qpos", "q", F.col("k.term").alias("term"), F.col("k.score").alias("score"))


# the same for few rows, on the driver ---


def _key(term: str) -> int:
    return sum((ord(x) - 64) * 27 ** (T.KEY_LETTERS - i) for i, x in enumerate(term[: T.KEY_LETTERS]))


def _score(query: str, key: str) -> float:
    common = next((i for i, (a, b) in enumerate(zip(query, key, strict=False)) if a != b), min(len(query), len(key)))
    damp = struct.unpack("f", struct.pack("f", 7.0 / (abs(len(query) - len(key)) + 7)))[0]
    return common * damp * (15 if query == key else 8 if common == len(query) else 1)


def _accepted(scored: list[tuple[int, str, float]]) -> list[tuple[str, float]]:
    """accepted_keys() of (term_ord, term, score)."""
    n, total, kept = 0, 0, []
    for _, term, score in sorted(scored):
        cutoff = T.FIRST_CUTOFF if n < T.FIRST_KEYS else float(math.floor((total + n) / n)) * T.CUTOFF_FACTOR
        if score >= cutoff:
            n, total = n + 1, int(total + score)
            kept.append((term, score))
    return kept


_STUBS: dict[tuple, dict[str, list[tuple[int, int]]] | None] = {}


def _stubs(index: Index) -> dict[str, list[tuple[int, int]]] | None:
    """(k27, term_ord) of every tenth term of each segment of a folder's index, kept for the session; None if they are more than STUBS."""
    at = (index.terms.sparkSession.sparkContext.applicationId, index.path, index.number)
    if at not in _STUBS:
        while len(_STUBS) >= 8:
            del _STUBS[next(iter(_STUBS))]
        rows = index.terms.where("is_stub").select("segment", "k27", "term_ord").limit(STUBS + 1).collect()
        found: dict[str, list[tuple[int, int]]] = {}
        for segment, k27, place in rows:
            found.setdefault(segment, []).append((k27, place))
        _STUBS[at] = None if len(rows) > STUBS else {k: sorted(v, key=lambda x: x[1]) for k, v in found.items()}
    return _STUBS[at]


def _bounds(stubs: dict[str, list[tuple[int, int]]], terms: list[str]) -> list[tuple[str, int, int, int, int]]:
    """window_bounds(): (segment, qpos, first_ord, first_key, end_key)."""
    out = []
    for segment, held in stubs.items():
        keys = [k for k, _ in held]
        for i, term in enumerate(terms):
            low, high = _key(term) - T.KEY_STEP, _key(term) + T.KEY_STEP
            under, over = bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)
            if under < len(keys):  # a stub that reaches the lower bound
                first = max(under - 1, 0)
                out.append((segment, i, held[first][1], keys[first], keys[min(over, len(keys) - 1)]))
    return out


def answered_terms(index: Index, terms: list[str], window: str = "stub") -> list[tuple] | None:
    """expanded_terms() as rows, found by one scan of the terms in question; None where those are more than SCANNED or the index is no folder's."""
    if window not in ("stub", "prefix"):
        raise ValueError(f"no such window: {window}")
    if not terms:
        raise ValueError("a query needs at least one term")
    stubs = _stubs(index) if index.number is not None else None
    if stubs is None:
        return None
    if window == "prefix":
        some = index.terms.where(_any([F.col("term").startswith(t) for t in terms]))
        wanted = [(segment, i, None, None, None) for segment in stubs for i in range(len(terms))]
    else:
        wanted = _bounds(stubs, terms)
        some = _narrowed(index.terms, "k27", [(s, a, b) for s, _, _, a, b in wanted])
    rows = some.select("segment", "term_ord", "term", "k27").limit(SCANNED + 1).collect() if wanted else []
    if len(rows) > SCANNED:
        return None
    by: dict[str, list[tuple[int, str, int]]] = {}
    for segment, place, term, k27 in rows:
        by.setdefault(segment, []).append((place, term, k27))
    out = []
    for segment, i, first, _, end in wanted:
        scored = []
        for place, term, k27 in sorted(by.get(segment, [])):
            if window == "prefix":
                if not term.startswith(terms[i]):
                    continue
            elif place < first or k27 > end:
                continue
            scored.append((place, term, _score(terms[i], term)))
            if k27 == end:
                break
        out += [(segment, i, terms[i], term, score) for term, score in _accepted([x for x in scored if x[2] >= T.FIRST_CUTOFF])]
    return out


# scores ---


def hit_scores(index: Index, keys: DataFrame, rows: list | None = None) -> DataFrame:
    """(segment, qpos, doc_id, score) of every posting of every accepted key. With the keys' rows, only their ranges of terms are read."""
    postings = index.postings
    if rows is not None:
        spans: dict[tuple[str, int], list[str]] = {}
        for r in rows:
            spans.setdefault((r.segment, r.qpos), []).append(r.term)
        postings = _narrowed(postings, "term", [(s, min(x), max(x)) for (s, _), x in spans.items()])
    few = keys if rows is None else F.broadcast(keys)  # HELD_ROWS at most
    return postings.join(few, ["segment", "term"]).select("segment", "qpos", "doc_id", T.posting_score(F.col("tf"), F.col("score")).alias("score"))


def document_scores(index: Index, keys: DataFrame) -> DataFrame:
    """(segment, qpos, doc_id, score) summed over a query term's accepted keys."""
    return hit_scores(index, keys).groupBy("segment", "qpos", "doc_id").agg(F.sum("score").alias("score"))


def position_keys(keys: DataFrame) -> DataFrame:
    """The accepted keys whose positions are worth showing."""
    return keys.where((F.col("term") == F.col("q")) | (F.col("score") >= POSITION_SCORE))
