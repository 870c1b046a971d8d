"""Queries on sources, on segments as they come and go, and on what a page of results shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import paths as P
from quillspark.functions import text as T
from quillspark.operators import docstore, index, paths, phrase, temporal
from quillspark.plans.retrieve import retrieve
from quillspark.queries import retrieval as R
from quillspark.queries import stores as S
from quillspark.queries.retrieval import PAIR, TRIO, built, documents
from quillspark.sources import readers
from quillspark.storage import new_path

PREFIXES = ["TION", "MENT"]
MANY = 12


# sources ---


def listed_batches(spark, sf_dir):
    """Nations as files, listed by name and read back in batches of ten."""
    path = new_path(spark, "files")
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows, whatever the scale
    for name, text in [(f"{r.n_nationkey}.txt", r.n_name) for r in rows] + [("listing", "\n".join(f"{r.n_nationkey}.txt" for r in rows))]:
        out = files.create(at(f"{path}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
    return readers.listed_files(spark, f"{path}/listing", path, most_files=10)


def fuzz_source(spark, sf_dir):
    words = readers.fuzzed_documents(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text")
    return words.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


def catalogue_lines(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" # "), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("  "), "n_name")).otherwise(" ").alias("value"))
    return readers.catalogued_segments(lines)


def crawl_status(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("status", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200)).withColumn("type", F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("text/html; charset=utf-8"))
    return readers.crawled_pages(pages, "html", "status", "type").select("page_id", "url")


def ascii_index(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.ascii_for_index(F.col("text")).alias("indexed"))


def names_insert(spark, sf_dir):
    """Names registered in two goes; what is there stays."""
    names = S._registry(spark, sf_dir).distinct()
    held = docstore.NameRegistry(spark, new_path(spark, "names"))
    held.insert(names.where("segment <> 's0'"))
    held.insert(names)
    return held.rows()


def stored_documents(spark, sf_dir):
    """Pages put into a store, then again with other urls: the first of an id counts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    store = docstore.DocumentStore(spark, new_path(spark, "store"))
    store.insert(pages, "page_id", "url", "html")
    store.insert(pages.withColumn("url", F.concat("url", F.lit("/late"))), "page_id", "url", "html")
    return store.rows()


# segments ---


def builder_index(spark, sf_dir):
    docs = documents(spark, sf_dir)
    builder = index.IndexBuilder(spark).append(docs.where("doc_id % 2 = 0"))
    held = builder.concat(index.IndexBuilder(spark).append(docs.where("doc_id % 2 = 1"))).persist("whole")
    return held.terms.drop("segment")


def _compacted(spark, sf_dir) -> index.Index:
    path = new_path(spark, "compacted")
    docs = documents(spark, sf_dir)
    index.write_index(docs.withColumn("_segment", F.concat(F.lit("s"), F.col("doc_id") % MANY)), path, "_segment")
    return index.compact(spark, path)


def compacted_index(spark, sf_dir):
    """Twelve segments become eight, with every position where it was."""
    return _compacted(spark, sf_dir).positions.select("term", "doc_id", "pos")


def compacted_vocabulary(spark, sf_dir):
    held = _compacted(spark, sf_dir)
    terms = held.terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    found = held.postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tf"))
    segments = held.terms.agg(F.count_distinct("segment").alias("segments"))
    return terms.join(found, "term").crossJoin(F.broadcast(segments))  # one row


def segment_faults(spark, sf_dir):
    """Every hundredth term with a count too many, and an ordinal out of place in each segment."""
    held = built(spark, sf_dir, R.PARTS)
    terms = held.terms.withColumn("cf", F.when(F.col("term_ord") % 100 == 0, F.col("cf") + 1).otherwise(F.col("cf"))).withColumn("term_ord", F.when(F.col("term_ord") == 5, -1).otherwise(F.col("term_ord")))
    return index.inconsistencies(index.Index(terms, held.postings, held.positions))


def tier_iterate(spark, sf_dir):
    """The second block of a term's documents."""
    return index.tier(index.tier_blocks(built(spark, sf_dir).postings), "THE", 1).select("doc_id", "tf")


# results ---


def prefix_and(spark, sf_dir):
    """Documents with terms that begin with each of the query's."""
    return retrieve(built(spark, sf_dir), PREFIXES, window="prefix").results.select("doc_id", "score")


def prefix_keys(spark, sf_dir):
    return retrieve(built(spark, sf_dir), PREFIXES, window="prefix").keys.select("q", "term", "score")


def best_five(spark, sf_dir):
    return retrieve(built(spark, sf_dir), TRIO, "or").best(5).select("doc_id", "score")


def phrase_three(spark, sf_dir):
    return retrieve(built(spark, sf_dir), TRIO).by_phrase().select("doc_id", "score", "difference")


def gaps_three(spark, sf_dir):
    return phrase.pair_gaps(built(spark, sf_dir).positions, TRIO).where("gap IS NOT NULL").select("doc_id", "pair", "gap")


def page_matches(spark, sf_dir):
    page = retrieve(built(spark, sf_dir), PAIR).page(documents(spark, sf_dir), url_col="source")
    return page.select("doc_id", "url", F.posexplode("matches").alias("n", "m")).select("doc_id", "url", "n", F.col("m.pos").alias("pos"), F.col("m.len").alias("len"))


# paths and versions ---


def path_functions(spark, sf_dir):
    table = S._customer_paths(spark, sf_dir)
    open_path = F.regexp_replace("path", "/$", "")
    return table.select("path", F.element_at(P.parts(F.col("path")), -1).alias("name"), P.from_parts(P.parts(F.col("path"))).alias("again"), P.joined(F.col("path"), F.lit("x")).alias("child"), P.closed(open_path).alias("closed"))


def json_leaf_text(spark, sf_dir):
    flat = paths.flattened_json(S._events_json(spark, sf_dir), "event_id", "props").where(F.col("path") != "/")
    return flat.select("event_id", "path", paths.as_text(F.col("kind"), F.col("s"), F.col("n")).alias("value"))


def store_transactions(spark, sf_dir):
    """Nations put one by one; some deleted, some written again in a transaction that is aborted, some in one that is not ended."""
    store = temporal.Store(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows, whatever the scale
    store.load({f"/nation/{r.n_nationkey}": r.n_name if r.n_nationkey % 2 else float(r.n_regionkey) for r in rows})
    for r in rows:
        txn = store.begin()
        store.write(txn, f"/nation/{r.n_nationkey}", None if r.n_nationkey % 5 == 0 else "again")
        if r.n_nationkey % 5 == 0:
            store.commit(txn)
        elif r.n_nationkey % 5 == 1:
            store.abort(txn)
    return store.read_range("/nation/")


def _read_log(spark, sf_dir) -> DataFrame:
    """Events as a log: each is a write of its value to its user's key, every fourth a read that saw the event's value in whole numbers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_id") % 4 == 0, "Read").otherwise("Write")
    cell = F.struct(op.alias("op"), F.concat(F.lit("/user/"), (F.col("user_id") % 50).cast("string")).alias("key"), F.lit("N").alias("kind"), F.lit(None).cast("string").alias("s"), F.floor(F.col("value") / 20).cast("double").alias("n"))
    return e.select((F.col("event_id") + 1).alias("timestamp"), F.array(cell).alias("ops"))


def failed_reads(spark, sf_dir):
    return temporal.failed_reads(_read_log(spark, sf_dir)).select("ts", "key")


def blocked_reads(spark, sf_dir):
    """Reads of every customer's key by transactions of which every third one has pending writes."""
    w = S._writes(spark, sf_dir)
    reads = w.where(F.col("op") % 7 == 0).select("key", (F.col("ts") + 300).alias("ts"), F.when(F.col("op") % 13 == 0, F.col("op")).otherwise(-F.col("op")).alias("txn_id"))
    return temporal.blocked_reads(reads, w, S._txns(w))


def unique_lookup(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"))
    wanted = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1").select(F.concat_ws("-", F.col("n_nationkey").cast("string"), F.lit("BUILDING")).alias("value"))
    return temporal.lookup(c, wanted).select("key", "value")


QUERIES = {
    f.__name__: f
    for f in (
        listed_batches, fuzz_source, catalogue_lines, crawl_status, ascii_index, names_insert, stored_documents, builder_index, compacted_index, compacted_vocabulary, segment_faults, tier_iterate,
        prefix_and, prefix_keys, best_five, phrase_three, gaps_three, page_matches, path_functions, json_leaf_text, store_transactions, failed_reads, blocked_reads, unique_lookup,
    )
}

_TRIO_GAPS = ", ".join(f"""gaps{i} AS (SELECT a.segment, a.doc_id, {i} AS pair, min(b.pos - a.pos)::INT AS gap FROM positions a JOIN positions b ON b.segment = a.segment AND b.doc_id = a.doc_id AND b.term = '{y}' AND b.pos >= a.pos
WHERE a.term = '{x}' GROUP BY ALL)""" for i, (x, y) in enumerate(zip(TRIO, TRIO[1:], strict=False)))
_WIDTHS = " + ".join(f"abs(g{i}.gap - {len(t) + 1})" for i, t in enumerate(TRIO[:-1]))

ORACLES = {
    "listed_batches": "SELECT n_nationkey::BIGINT + 1 AS doc_id, (n_nationkey // 10)::INT AS batch, n_nationkey || '.txt' AS name, n_name AS text FROM nation",
    "fuzz_source": r"SELECT 3::BIGINT AS doc_id, w AS text, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text), '\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY w",
    "catalogue_lines": "SELECT n_name AS segment FROM nation WHERE n_nationkey % 3 = 1",
    "crawl_status": "SELECT page_id, url FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND html IS NOT NULL",
    "ascii_index": r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS indexed FROM documents",
    "names_insert": f"WITH {S._REGISTRY} SELECT coalesce(min(segment) FILTER (WHERE segment <> 's0'), 's0') AS segment, path FROM reg GROUP BY path",
    "stored_documents": r"""SELECT page_id AS id, regexp_replace(url, '["\\]|[^\x00-\x7F]', '', 'g') AS url, regexp_replace(html, '["\\]|[^\x00-\x7F]', '', 'g') AS contents FROM pages""",
    "builder_index": f"WITH {R._index()} SELECT term, term_ord, k27, is_stub, df, cf FROM terms",
    "compacted_index": f"WITH {R._tokens()} SELECT term, doc_id, pos FROM positions",
    "compacted_vocabulary": f"WITH {R._index()} SELECT term, df, cf, df AS postings, cf AS tf, 8::BIGINT AS segments FROM vocab",
    "segment_faults": f"""WITH {R._index(R._PARTS)}, faults AS (SELECT segment, count(*) AS n FROM terms WHERE term_ord % 100 = 0 GROUP BY segment)
SELECT segment, 'positions' AS problem, n FROM faults UNION ALL SELECT segment, 'postings', n FROM faults UNION ALL SELECT segment, 'unsorted', 1 FROM faults""",
    "tier_iterate": f"WITH {R._index()} SELECT doc_id, tf FROM postings WHERE term = 'THE' ORDER BY tf, doc_id LIMIT 256 OFFSET 256",
    "prefix_and": f"{R._and(PREFIXES, window='prefix')} SELECT doc_id, score FROM every",
    "prefix_keys": f"{R._accept(PREFIXES, window='prefix')} SELECT q, term, score FROM keys",
    "best_five": f"{R._accept(TRIO)} SELECT doc_id, sum(score)::BIGINT AS score FROM scores GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5",
    "phrase_three": f"""{R._and(TRIO)}, {_TRIO_GAPS}, ranked AS (SELECT e.doc_id, e.score, ({_WIDTHS})::BIGINT AS difference FROM every e LEFT JOIN gaps0 g0 USING (segment, doc_id) LEFT JOIN gaps1 g1 USING (segment, doc_id))
SELECT doc_id, score * CASE WHEN difference <= 2 THEN 100 WHEN difference <= 5 THEN 50 WHEN difference <= 10 THEN 25 WHEN difference <= 20 THEN 10 ELSE 1 END AS score, difference FROM ranked""",
    "gaps_three": f"WITH {R._tokens()}, {_TRIO_GAPS} SELECT doc_id, pair, gap FROM gaps0 UNION ALL SELECT doc_id, pair, gap FROM gaps1",
    "page_matches": f"{R._and(PAIR)}, {R._SPANS} SELECT m.doc_id, d.source AS url, (m.span - 1)::INT AS n, m.pos::INT AS pos, m.len::INT AS len FROM merged m JOIN documents d USING (doc_id)",
    "path_functions": f"""WITH {S._CUST} SELECT path, regexp_extract(path, '([^/]*)/$', 1) AS name, path AS again, path || 'x' AS child, path AS closed FROM cells""",
    "json_leaf_text": """SELECT event_id, replace(replace(t.fullkey, '$', ''), '.', '/') || '/' AS path, t.atom ->> '$' AS value FROM events, json_tree(props::JSON) t WHERE t.type <> 'OBJECT'""",
    "store_transactions": """SELECT '/nation/' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 1 THEN 'S' ELSE 'N' END AS kind, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS s, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::DOUBLE END AS n
FROM nation WHERE n_nationkey % 5 <> 0""",
    "failed_reads": """WITH ops AS (SELECT event_id + 1 AS ts, '/user/' || (user_id % 50) AS key, event_id % 4 = 0 AS is_read, floor(value / 20) AS n FROM events),
seen AS (SELECT *, last_value(CASE WHEN NOT is_read THEN n END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ops)
SELECT ts, key FROM seen WHERE is_read AND coalesce(n <> before, true)""",
    "blocked_reads": f"""WITH {S._WRITES}, pending AS (SELECT key, op, ts FROM writes WHERE op % 11 <> 0 AND op % 13 = 0),
reads AS (SELECT key, ts + 300 AS ts, CASE WHEN op % 13 = 0 THEN op ELSE -op END AS txn_id FROM writes WHERE op % 7 = 0)
SELECT key, ts, txn_id FROM reads r WHERE EXISTS (SELECT 1 FROM pending p WHERE p.key = r.key AND p.op <> r.txn_id AND p.ts <= r.ts)""",
    "unique_lookup": "SELECT c_custkey AS key, c_nationkey || '-' || c_mktsegment AS value FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING'",
}
