"""Queries on tokens, terms, scores, matches and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import expand, highlight, index, match, phrase
from quillspark.plans.retrieve import retrieve, retrieve_exact
from quillspark.storage import new_path
from quillspark.streaming import incremental

PAIR = ["THE", "TION"]
TRIO = ["THAT", "TION", "THE"]
EVERY = ["THE", "AND", "THAT", "TION", "MENT", "ORANTION", "EINLICH", "WORTHLESS", "CAN"]
PARTS = 4

_KEPT: dict[tuple[str, str, str], str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def built(spark: SparkSession, sf_dir: str, parts: int = 1) -> index.Index:
    """The index of a folder's documents, written once a session; in parts, segment k has the ids k modulo parts."""
    key = (spark.sparkContext.applicationId, sf_dir, str(parts))
    if key not in _KEPT:
        path = new_path(spark, "index")
        docs = documents(spark, sf_dir)
        index.write_index(docs.withColumn("_segment", F.concat(F.lit("s"), F.col("doc_id") % parts)), path, "_segment")
        _KEPT[key] = path
    return index.open_index(spark, _KEPT[key])


# SQL ---

_STOP = ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))
_POWERS = ", ".join(str(27 ** (11 - i)) for i in range(11))


def _key(term: str) -> str:
    return f"list_sum(list_transform(range(0, least(length({term}), 11)), lambda i: (ascii(substr({term}, (i + 1)::INT, 1)) - 64)::BIGINT * ([{_POWERS}]::BIGINT[])[i + 1]))::BIGINT"


def _tokens(segment: str = "'s0'", name: str = "positions", stop_words: bool = True) -> str:
    stop = f"AND (last OR raw NOT IN ({_STOP}))" if stop_words else ""
    return f"""
runs AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '[A-Za-z]+') AS ws, regexp_split_to_array(text, '[A-Za-z]+') AS gs FROM documents WHERE text IS NOT NULL),
cells AS (SELECT doc_id, n, unnest(ws) AS raw, unnest(gs[1:len(ws)]) AS gap, unnest(range(len(ws))) AS i FROM runs),
placed AS (SELECT doc_id, n, raw, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cells),
capped AS (SELECT doc_id, start + length(raw) = n AS last, CASE WHEN length(raw) > 50 AND start + length(raw) <> n THEN right(raw, 50) ELSE raw END AS raw,
                  CASE WHEN length(raw) > 50 AND start + length(raw) <> n THEN start + length(raw) - 50 ELSE start END AS pos FROM placed),
{name} AS MATERIALIZED (SELECT {segment} AS segment, upper(raw) AS term, doc_id, pos::INT AS pos FROM capped WHERE length(raw) >= 3 {stop})"""


def _index(segment: str = "'s0'") -> str:
    return f"""{_tokens(segment)},
postings AS MATERIALIZED (SELECT segment, term, doc_id, count(*)::INT AS tf FROM positions GROUP BY ALL),
vocab AS (SELECT segment, term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY term) - 1 AS term_ord, count(*) OVER (PARTITION BY segment) AS many FROM vocab),
terms AS MATERIALIZED (SELECT segment, term, term_ord, {_key('term')} AS k27, term_ord % 10 = 0 OR term_ord = many - 1 AS is_stub, df, cf FROM numbered)"""


def _scan(terms: list[str], segment: str = "'s0'", window: str = "stub") -> str:
    between = "t.segment = s.segment AND t.term_ord BETWEEN first_ord AND stop_ord" if window == "stub" else "t.segment = s.segment AND starts_with(term, q)"
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""{_index(segment)},
queries AS (SELECT qpos, q, {_key('q')} AS qkey FROM (VALUES {values}) v(qpos, q)),
bounds AS (SELECT segment, qpos, q, coalesce(max(term_ord) FILTER (WHERE k27 < qkey - {27**7}), min(term_ord)) AS first_ord,
                  coalesce(min(term_ord) FILTER (WHERE k27 > qkey + {27**7}), max(term_ord)) AS end_ord, bool_or(k27 >= qkey - {27**7}) AS reached
           FROM terms, queries WHERE is_stub GROUP BY segment, qpos, q),
ends AS (SELECT b.*, t.k27 AS end_key FROM bounds b JOIN terms t ON t.segment = b.segment AND t.term_ord = b.end_ord WHERE reached),
stops AS (SELECT e.segment, e.qpos, e.q, e.first_ord, min(t.term_ord) AS stop_ord FROM ends e JOIN terms t ON t.segment = e.segment AND t.term_ord >= e.first_ord AND t.k27 >= e.end_key GROUP BY ALL),
compared AS (SELECT t.segment, qpos, q, term, term_ord, len(list_filter(range(1, least(length(q), length(term)) + 1), lambda i: left(q, i) = left(term, i))) AS common
             FROM terms t JOIN {"stops" if window == "stub" else "(SELECT segment, qpos, q FROM queries, (SELECT DISTINCT segment FROM terms))"} s ON {between}),
scored AS (SELECT segment, qpos, q, term, term_ord, common::DOUBLE * (7.0::DOUBLE / (7 + abs(length(q) - length(term))))::FLOAT::DOUBLE
                  * CASE WHEN q = term THEN 15 WHEN common = length(q) THEN 8 ELSE 1 END AS score FROM compared)"""


def _accept(terms: list[str], segment: str = "'s0'", window: str = "stub") -> str:
    """The cutoff as a recursion over the scan's order."""
    return f"""WITH RECURSIVE {_scan(terms, segment, window)},
scan AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY segment, qpos ORDER BY term_ord) AS step FROM scored WHERE score >= 4),
folded AS (
  SELECT segment, qpos, step, 1::BIGINT AS n, trunc(score)::BIGINT AS total, true AS taken FROM scan WHERE step = 1
  UNION ALL
  SELECT s.segment, s.qpos, s.step, f.n + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN trunc(f.total + s.score)::BIGINT ELSE f.total END, ok
  FROM folded f JOIN scan s ON s.segment = f.segment AND s.qpos = f.qpos AND s.step = f.step + 1,
       LATERAL (SELECT s.score >= CASE WHEN f.n < 12 THEN 4::DOUBLE ELSE ((f.total + f.n) // f.n)::DOUBLE * 1.9::DOUBLE END AS ok)),
keys AS (SELECT s.segment, s.qpos, s.q, s.term, s.score FROM scan s JOIN folded f ON s.segment = f.segment AND s.qpos = f.qpos AND s.step = f.step WHERE taken),
scores AS (SELECT k.segment, qpos, doc_id, sum(trunc((log10(tf) + 1) * score)::BIGINT)::BIGINT AS score FROM keys k JOIN postings p ON p.segment = k.segment AND p.term = k.term GROUP BY ALL)"""


_ALL = """sizes AS (SELECT segment, qpos, count(*) AS size FROM scores GROUP BY ALL),
every AS (SELECT segment, doc_id, trunc(list_reduce(list(s.score::DOUBLE * 1.3::DOUBLE ORDER BY size, s.qpos), lambda a, x: a + x, 0::DOUBLE))::BIGINT AS score
          FROM scores s JOIN sizes z USING (segment, qpos) GROUP BY segment, doc_id HAVING count(*) = {n})"""


def _and(terms: list[str], segment: str = "'s0'", window: str = "stub") -> str:
    return f"{_accept(terms, segment, window)}, {_ALL.format(n=len(terms))}"


_SPANS = """top AS (SELECT segment, doc_id, score FROM every ORDER BY score DESC, doc_id LIMIT 20),
wanted AS (SELECT DISTINCT segment, term FROM keys WHERE q = term OR score >= 20),
places AS (SELECT DISTINCT p.segment, p.doc_id, p.pos, length(p.term)::INT AS len FROM positions p JOIN wanted USING (segment, term) JOIN top USING (segment, doc_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, len) AS i FROM places),
spans AS (
  SELECT doc_id, i, 1 AS span, pos, len FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.i, CASE WHEN near THEN s.span ELSE s.span + 1 END, CASE WHEN near THEN s.pos ELSE o.pos END, CASE WHEN near THEN o.len + o.pos - s.pos ELSE o.len END
  FROM spans s JOIN ordered o ON o.doc_id = s.doc_id AND o.i = s.i + 1, LATERAL (SELECT o.pos - s.pos - s.len < 30 AS near)),
merged AS (SELECT doc_id, span, arg_max(pos, i) AS pos, arg_max(len, i) AS len FROM spans GROUP BY ALL)"""


# queries ---


def tokenize_positions(spark, sf_dir):
    return index.positions_of(documents(spark, sf_dir)).select("term", "doc_id", "pos")


def stopword_filter(spark, sf_dir):
    return index.stop_word_counts(documents(spark, sf_dir)).where("with_stop_words <> kept")


def term_freq(spark, sf_dir):
    return built(spark, sf_dir).postings.select("term", "doc_id", "tf")


def vocabulary(spark, sf_dir):
    return built(spark, sf_dir).terms.select("term", "term_ord", "k27", "is_stub", "df", "cf")


def exact_term_topk(spark, sf_dir):
    return match.best(retrieve_exact(built(spark, sf_dir), "THE")).select("doc_id", "score")


def prefix_score_vectors(spark, sf_dir):
    pairs = [("TEST", "TEST"), ("TEST", "TESTING"), ("TESTING", "TEST"), ("TESTER", "TESTED"), ("CAN", "CANADIAN"), ("CAN", "CANADA"), ("CAN", "CAR"), ("WIKI", "WIKIBOOKS")]
    return spark.createDataFrame(pairs, "q string, term string").select("q", "term", T.match_score(F.col("q"), F.col("term")).alias("score"), T.term_key(F.col("term")).alias("k27"))


def expand_window(spark, sf_dir):
    return expand.scanned_terms(built(spark, sf_dir), expand.query_terms(spark, EVERY)).select("q", "term", "term_ord", "score")


def expand_cutoff(spark, sf_dir):
    return expand.expanded_terms(built(spark, sf_dir), expand.query_terms(spark, EVERY)).select("q", "term", "score")


def search_single(spark, sf_dir):
    return retrieve(built(spark, sf_dir), ["MENT"]).results.select("doc_id", "score")


def search_and(spark, sf_dir):
    return retrieve(built(spark, sf_dir), TRIO).results.select("doc_id", "score")


def search_or(spark, sf_dir):
    return retrieve(built(spark, sf_dir), TRIO, "or").results.select("doc_id", "score")


def search_and_or_fallback(spark, sf_dir):
    return retrieve(built(spark, sf_dir), ["ORANTION", "ZZZYX"], "and_or_fallback").results.select("doc_id", "score")


def topk20(spark, sf_dir):
    return retrieve(built(spark, sf_dir), PAIR).best().select("doc_id", "score")


def match_positions(spark, sf_dir):
    return retrieve(built(spark, sf_dir), PAIR).positions(20).select("doc_id", "pos", "len")


def span_merge(spark, sf_dir):
    spans = highlight.spans_of(retrieve(built(spark, sf_dir), PAIR).positions(20))
    return spans.select("doc_id", F.posexplode("matches").alias("n", "m")).select("doc_id", (F.col("n") + 1).alias("span"), F.col("m.pos").alias("pos"), F.col("m.len").alias("len"))


def snippets(spark, sf_dir):
    return retrieve(built(spark, sf_dir), PAIR).page(documents(spark, sf_dir)).select("doc_id", "score", "snippet")


def marked_text(spark, sf_dir):
    """The whole texts of a page of results, each match marked."""
    found = retrieve(built(spark, sf_dir), PAIR)
    page = found.page(documents(spark, sf_dir))
    texts = documents(spark, sf_dir).select("doc_id", "text").join(F.broadcast(page.select("doc_id", "matches")), "doc_id")  # a page of results
    return texts.select("doc_id", F.posexplode(highlight.marked_segments(F.col("text"), F.coalesce("matches", F.expr("cast(array() AS array<struct<pos:int,len:int>>)")))).alias("n", "m")).select("doc_id", "n", F.col("m.text").alias("text"), F.col("m.mark").alias("mark"))


def phrase_rerank(spark, sf_dir):
    return retrieve(built(spark, sf_dir), PAIR).by_phrase().select("doc_id", "score", "difference")


def proximity_min(spark, sf_dir):
    return phrase.pair_gaps(built(spark, sf_dir).positions, PAIR).where("gap IS NOT NULL").select("doc_id", "gap")


def first_matches(spark, sf_dir):
    held = built(spark, sf_dir).positions.where(F.col("term") == "TION")
    return phrase.first_matches(held).select("doc_id", F.posexplode("places").alias("n", "pos"))


def tier_blocks(spark, sf_dir):
    return index.tier_blocks(built(spark, sf_dir).postings).groupBy("term", "tier").agg(F.count(F.lit(1)).alias("docs"), F.min("tf").alias("least_tf"), F.max("tf").alias("most_tf"), F.sum("doc_id").alias("doc_ids"))


def segment_vocabulary(spark, sf_dir):
    return built(spark, sf_dir, PARTS).terms


def segment_merge(spark, sf_dir):
    parts = built(spark, sf_dir, PARTS)
    merged = index.merge_segments(parts, ["s0", "s1"], "s0+s1")
    return merged.terms


def segment_consistency(spark, sf_dir):
    return index.inconsistencies(built(spark, sf_dir, PARTS))


def multi_index_search(spark, sf_dir):
    return retrieve(built(spark, sf_dir, PARTS), PAIR).results.select("segment", "doc_id", "score")


def multi_index_join(spark, sf_dir):
    return retrieve(built(spark, sf_dir, PARTS), PAIR).joined()


def incremental_index(spark, sf_dir):
    """Documents read as a stream give the same counts as all at once."""
    path, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    source = spark.readStream.schema(documents(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parquet*")
    incremental.index_stream(source, path, checkpoint).awaitTermination()
    held = index.open_index(spark, path).postings
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_positions, stopword_filter, term_freq, vocabulary, exact_term_topk, prefix_score_vectors, expand_window, expand_cutoff, search_single, search_and, search_or,
        search_and_or_fallback, topk20, match_positions, span_merge, snippets, marked_text, phrase_rerank, proximity_min, first_matches, tier_blocks, segment_vocabulary, segment_merge,
        segment_consistency, multi_index_search, multi_index_join, incremental_index,
    )
}

_PARTS = f"'s' || (doc_id % {PARTS})"
_GAPS = f"""firsts AS (SELECT segment, doc_id, pos FROM positions WHERE term = '{PAIR[0]}'), seconds AS (SELECT segment, doc_id, pos FROM positions WHERE term = '{PAIR[1]}'),
gaps AS (SELECT segment, doc_id, min(b.pos - a.pos)::INT AS gap FROM firsts a JOIN seconds b USING (segment, doc_id) WHERE b.pos >= a.pos GROUP BY ALL)"""

ORACLES = {
    "tokenize_positions": f"WITH {_tokens()} SELECT term, doc_id, pos FROM positions",
    "stopword_filter": f"WITH {_tokens(stop_words=False, name='every')}, kept AS (SELECT doc_id, count(*) AS n FROM capped WHERE length(raw) >= 3 AND (last OR raw NOT IN ({_STOP})) GROUP BY ALL) SELECT e.doc_id, count(*)::INT AS with_stop_words, coalesce(any_value(k.n), 0)::INT AS kept FROM every e LEFT JOIN kept k USING (doc_id) GROUP BY e.doc_id HAVING count(*) <> coalesce(any_value(k.n), 0)",
    "term_freq": f"WITH {_index()} SELECT term, doc_id, tf FROM postings",
    "vocabulary": f"WITH {_index()} SELECT term, term_ord, k27, is_stub, df, cf FROM terms",
    "exact_term_topk": f"WITH {_index()} SELECT doc_id, trunc((log10(tf) + 1) * 45)::BIGINT AS score FROM postings WHERE term = 'THE' ORDER BY score DESC, doc_id LIMIT 20",
    "prefix_score_vectors": f"SELECT q, term, score, {_key('term')} AS k27 FROM (VALUES ('TEST', 'TEST', 60.0::DOUBLE), ('TEST', 'TESTING', 22.399999618530273::DOUBLE), ('TESTING', 'TEST', 2.799999952316284::DOUBLE), ('TESTER', 'TESTED', 5.0::DOUBLE), ('CAN', 'CANADIAN', 13.999999523162842::DOUBLE), ('CAN', 'CANADA', 16.799999713897705::DOUBLE), ('CAN', 'CAR', 2.0::DOUBLE), ('WIKI', 'WIKIBOOKS', 18.66666603088379::DOUBLE)) v(q, term, score)",
    "expand_window": f"WITH {_scan(EVERY)} SELECT q, term, term_ord, score FROM scored",
    "expand_cutoff": f"{_accept(EVERY)} SELECT q, term, score FROM keys",
    "search_single": f"{_accept(['MENT'])} SELECT doc_id, score FROM scores",
    "search_and": f"{_and(TRIO)} SELECT doc_id, score FROM every",
    "search_or": f"{_accept(TRIO)} SELECT doc_id, sum(score)::BIGINT AS score FROM scores GROUP BY doc_id",
    "search_and_or_fallback": f"{_and(['ORANTION', 'ZZZYX'])} SELECT doc_id, score FROM every UNION ALL SELECT doc_id, sum(score)::BIGINT FROM scores WHERE NOT EXISTS (SELECT 1 FROM every) GROUP BY doc_id",
    "topk20": f"{_and(PAIR)} SELECT doc_id, score FROM every ORDER BY score DESC, doc_id LIMIT 20",
    "match_positions": f"{_and(PAIR)}, {_SPANS} SELECT doc_id, pos, len FROM places",
    "span_merge": f"{_and(PAIR)}, {_SPANS} SELECT doc_id, span::INT AS span, pos::INT AS pos, len::INT AS len FROM merged",
    "snippets": f"""{_and(PAIR)}, {_SPANS},
shown AS (SELECT doc_id, pos, len, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, pos DESC) AS r FROM merged),
cut AS (SELECT doc_id, string_agg(substr(text, pos + 1, len), '...' ORDER BY len, pos) AS snippet FROM shown JOIN documents USING (doc_id) WHERE r <= 6 GROUP BY doc_id)
SELECT t.doc_id, t.score, c.snippet FROM top t LEFT JOIN cut c USING (doc_id)""",
    "marked_text": f"""{_and(PAIR)}, {_SPANS},
wide AS (SELECT m.doc_id, d.text, length(regexp_replace(left(d.text, greatest(m.pos - 10, 0)::INT), '[^ ]*$', '')) AS start,
                least(m.pos + m.len + 20 + length(regexp_extract(substr(d.text, (m.pos + m.len + 21)::INT), '^[^ ]*')), length(d.text)) AS stop FROM merged m JOIN documents d USING (doc_id)),
reach AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM wide),
named AS (SELECT *, sum(CASE WHEN start > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS mark_no FROM reach),
marks AS (SELECT doc_id, any_value(text) AS text, mark_no, min(start) AS start, max(stop) AS stop FROM named GROUP BY doc_id, mark_no),
gaps AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS past FROM marks),
pieces AS (SELECT doc_id, past AS place, substr(text, (past + 1)::INT, (start - past)::INT) AS text, false AS mark FROM gaps
           UNION ALL SELECT doc_id, start, substr(text, (start + 1)::INT, (stop - start)::INT), true FROM gaps
           UNION ALL SELECT t.doc_id, coalesce(g.stop, 0), substr(d.text, (coalesce(g.stop, 0) + 1)::INT), false FROM top t JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, max(stop) AS stop FROM gaps GROUP BY doc_id) g USING (doc_id))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS n, text, mark FROM pieces WHERE text <> ''""",
    "phrase_rerank": f"""{_and(PAIR)}, {_GAPS}, ranked AS (SELECT e.doc_id, e.score, abs(gap - {len(PAIR[0]) + 1})::BIGINT AS difference FROM every e LEFT JOIN gaps USING (segment, doc_id))
SELECT doc_id, score * CASE WHEN difference <= 2 THEN 100 WHEN difference <= 5 THEN 50 WHEN difference <= 10 THEN 25 WHEN difference <= 20 THEN 10 ELSE 1 END AS score, difference FROM ranked""",
    "proximity_min": f"WITH {_tokens()}, {_GAPS} SELECT doc_id, gap FROM gaps",
    "first_matches": f"WITH {_tokens()}, r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM positions WHERE term = 'TION') SELECT doc_id, n::INT AS n, pos FROM r WHERE n < 4",
    "tier_blocks": f"WITH {_index()}, tiers AS (SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY tf, doc_id) - 1) // 256)::INT AS tier FROM postings) SELECT term, tier, count(*)::BIGINT AS docs, min(tf) AS least_tf, max(tf) AS most_tf, sum(doc_id)::BIGINT AS doc_ids FROM tiers GROUP BY term, tier",
    "segment_vocabulary": f"WITH {_index(_PARTS)} SELECT * FROM terms",
    "segment_merge": "WITH " + _index(f"CASE WHEN doc_id % {PARTS} < 2 THEN 's0+s1' ELSE {_PARTS} END") + " SELECT * FROM terms",
    "segment_consistency": "SELECT '' AS segment, '' AS problem, 0::BIGINT AS n WHERE false",
    "multi_index_search": f"{_and(PAIR, _PARTS)} SELECT segment, doc_id, score FROM every",
    "multi_index_join": f"""{_and(PAIR, _PARTS)},
line AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY segment, score DESC, doc_id) AS i FROM every),
taken AS (
  SELECT i, 1::BIGINT AS n, score::FLOAT AS mean, true AS ok FROM line WHERE i = 1
  UNION ALL
  SELECT l.i, CASE WHEN good THEN t.n + 1 ELSE t.n END, CASE WHEN good THEN (((t.n::DOUBLE * t.mean::DOUBLE)::FLOAT::DOUBLE + l.score::DOUBLE)::FLOAT::DOUBLE / (t.n + 1)::DOUBLE)::FLOAT ELSE t.mean END, good
  FROM taken t JOIN line l ON l.i = t.i + 1, LATERAL (SELECT l.score >= CASE WHEN t.n < 40 THEN 0 ELSE trunc((t.mean::DOUBLE / 1.2::FLOAT::DOUBLE)::FLOAT)::BIGINT END AS good))
SELECT segment, doc_id, score FROM line JOIN taken USING (i) WHERE ok""",
    "incremental_index": f"WITH {_index()} SELECT term, df, cf FROM vocab",
}
