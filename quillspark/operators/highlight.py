"""From matched places to spans, snippets and marked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let

#: Spans this near to each other become one; spans shown; and what is added around a mark before it is rounded to words.
SPAN_GAP, SNIPPET_SPANS, MARK_BEFORE, MARK_AFTER = 30, 6, 10, 20


def merged_spans(places: Column) -> Column:
    """Of an array of structs (pos, len): sorted, with those near to their predecessor made one with it."""

    def step(spans: Column, x: Column) -> Column:
        last = F.element_at(spans, -1)
        near = x.getField("pos") - last.getField("pos") - last.getField("len") < SPAN_GAP
        wide = F.struct(last.getField("pos").alias("pos"), (x.getField("len") + x.getField("pos") - last.getField("pos")).alias("len"))
        joined = F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(wide))
        return F.when(F.size(spans) == 0, F.array(x)).when(near, joined).otherwise(F.concat(spans, F.array(x)))

    return let(F.array_sort(places), lambda p: F.aggregate(p, F.filter(p, lambda x: F.lit(False)), step))


def snippet(text: Column, spans: Column, most: int = SNIPPET_SPANS) -> Column:
    """The text of the longest spans, from the shortest on, with dots between."""

    def shown(s: Column) -> Column:
        by_size = F.array_sort(F.transform(s, lambda x: F.struct(x.getField("len").alias("len"), x.getField("pos").alias("pos"))))
        return F.slice(by_size, F.greatest(F.size(s) - (most - 1), F.lit(1)), F.lit(most))

    cut = F.transform(shown(spans), lambda x: F.substr(text, x.getField("pos") + 1, x.getField("len")))
    return F.array_join(cut, "...")


def spans_of(positions: DataFrame) -> DataFrame:
    """(segment, doc_id, matches) with the merged spans of a document's places."""
    lists = positions.groupBy("segment", "doc_id").agg(F.collect_list(F.struct("pos", "len")).alias("_places"))
    return lists.select("segment", "doc_id", merged_spans(F.col("_places")).alias("matches"))


def shown_results(results: DataFrame, spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", url_col: str | None = None) -> DataFrame:
    """(doc_id, score, url, snippet, matches) for each of a page of results; those without spans have null snippet and matches."""
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    held = docs.select(F.col(id_col).alias("doc_id"), url.alias("url"), F.col(text_col).alias("_text"))
    few = results.join(spans, ["segment", "doc_id"], "left")
    texts = held.join(F.broadcast(results.select("doc_id").distinct()), "doc_id")  # a page of results: the documents stay where they are
    joined = few.join(texts, "doc_id", "left")
    cut = F.when(F.col("matches").isNotNull(), snippet(F.col("_text"), F.col("matches")))
    return joined.select("doc_id", "score", "url", cut.alias("snippet"), "matches")


def marked_segments(text: Column, spans: Column, before: int = MARK_BEFORE, after: int = MARK_AFTER) -> Column:
    """The whole text as structs (text, mark): each span widened to whole words, and what lies between."""

    def widen(s: Column) -> Column:
        low = F.greatest(s.getField("pos") - before, F.lit(0))
        start = F.length(F.regexp_replace(F.left(text, low), "[^ ]*$", ""))
        high = s.getField("pos") + s.getField("len") + after
        rest = F.regexp_extract(F.substr(text, high + 1), "^[^ ]*", 0)
        return F.struct(start.cast("int").alias("pos"), (F.least(high + F.length(rest), F.length(text)) - start).cast("int").alias("len"))

    def union(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last.getField("pos") + last.getField("len"), x.getField("pos") + x.getField("len"))
        wide = F.struct(last.getField("pos").alias("pos"), (end - last.getField("pos")).alias("len"))
        over = x.getField("pos") <= last.getField("pos") + last.getField("len")
        return F.when(F.size(done) == 0, F.array(x)).when(over, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wide))).otherwise(F.concat(done, F.array(x)))

    wide = F.array_sort(F.transform(spans, widen))
    clean = let(wide, lambda w: F.aggregate(w, F.filter(w, lambda x: F.lit(False)), union))

    def pieces(marks: Column) -> Column:
        def around(x: Column, i: Column) -> Column:
            past = F.when(i == 0, 0).otherwise(F.element_at(marks, F.greatest(i, F.lit(1))).getField("pos") + F.element_at(marks, F.greatest(i, F.lit(1))).getField("len"))
            plain = F.struct(F.substr(text, past + 1, x.getField("pos") - past).alias("text"), F.lit(False).alias("mark"))
            return F.array(plain, F.struct(F.substr(text, x.getField("pos") + 1, x.getField("len")).alias("text"), F.lit(True).alias("mark")))

        last = F.element_at(marks, -1)
        end = F.when(F.size(marks) == 0, 0).otherwise(last.getField("pos") + last.getField("len"))
        tail = F.array(F.struct(F.substr(text, end + 1).alias("text"), F.lit(False).alias("mark")))
        return F.filter(F.concat(F.flatten(F.transform(marks, around)), tail), lambda p: p.getField("text") != "")

    return let(clean, pieces)
