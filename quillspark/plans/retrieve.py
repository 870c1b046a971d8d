"""From a query's terms to a page of results, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillspark.operators import expand, highlight, match, phrase
from quillspark.operators.index import Index
from quillspark.storage import HELD_ROWS, held, local_rows

MODES = ("and", "or", "and_or_fallback")


@dataclass
class Found:
    """Every matching document with its score, the accepted keys, and the index they came from."""

    index: Index
    terms: list[str]
    keys: DataFrame
    results: DataFrame

    def best(self, limit: int = 20) -> DataFrame:
        return match.best(self.results, limit)

    def positions(self, limit: int | None = None) -> DataFrame:
        """(segment, doc_id, pos, len) of keys worth showing, in all results or the best ones."""
        results = self.results if limit is None else self.best(limit)
        return phrase.match_positions(self.index, expand.position_keys(self.keys), results)

    def page(self, docs: DataFrame, limit: int = 20, id_col: str = "doc_id", text_col: str = "text", url_col: str | None = None) -> DataFrame:
        """The best documents with url, snippet and matched spans, best first."""
        top, rows = held(self.best(limit))
        index, keys = self.index, expand.position_keys(self.keys)
        if rows is not None:  # the page's documents and no others are read, and of the index the terms shown
            ids = [r.doc_id for r in rows]
            keys, shown = held(keys)
            places = index.positions.where(F.col("doc_id").isin(*ids))
            index = Index(index.terms, index.postings, places if shown is None else places.where(F.col("term").isin(*{r.term for r in shown})))
            docs = docs.where(F.col(id_col).isin(*ids))
        spans = highlight.spans_of(phrase.match_positions(index, keys, top))
        return highlight.shown_results(top, spans, docs, id_col, text_col, url_col).orderBy(F.col("score").desc(), "doc_id")

    def by_phrase(self) -> DataFrame:
        """(segment, doc_id, score, difference): scores scaled up where the terms follow each other."""
        held = self.index.positions.where(F.col("term").isin(*self.terms)).join(self.results.select("segment", "doc_id"), ["segment", "doc_id"], "left_semi")
        return phrase.rerank(self.results, held, self.terms)

    def joined(self) -> DataFrame:
        """Results of all segments, without those that lag behind."""
        return match.joined_segments(self.results)


def retrieve(index: Index, terms: list[str], mode: str = "and", window: str = "stub") -> Found:
    """Documents that answer the terms, in capitals: all of them, any, or any where all give nothing.

    The accepted keys are found at once, by one scan of the terms between bounds
    that a session keeps, or by small jobs where there are too many, so that the
    postings are read by ranges of terms; the results are a plan.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    terms = [t.upper() for t in terms if t]
    spark = index.terms.sparkSession
    found = expand.answered_terms(index, terms, window)
    if found is not None and len(found) <= HELD_ROWS:
        rows = [Row(segment=s, qpos=i, term=t) for s, i, _, t, _ in found]
        keys = local_rows(spark, found, "segment string, qpos int, q string, term string, score double")
    else:
        keys, rows = held(expand.expanded_terms(index, expand.query_terms(spark, terms), window))
    scores = expand.hit_scores(index, keys, rows)
    results = {"and": lambda: match.match_all(scores, len(terms)), "or": lambda: match.match_any(scores), "and_or_fallback": lambda: match.match_all_or_any(scores, len(terms))}[mode]()
    return Found(index, terms, keys, results)


def retrieve_exact(index: Index, term: str) -> DataFrame:
    """(segment, doc_id, score) of the documents with one exact term; the filter reaches the scan of the postings."""
    hits = index.postings.where(F.col("term") == term)
    return hits.select("segment", "doc_id", ((F.log10(F.col("tf").cast("double")) + 1) * (15.0 * len(term))).cast("long").alias("score"))
