"""Queries on documents, names, JSON, paths, versions and the SELECT dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import docstore, paths, temporal
from quillspark.plans import select
from quillspark.queries.retrieval import documents
from quillspark.sources import readers
from quillspark.storage import new_path

#: Literal JSON with what the tables' own lacks.
NESTED = '{"name": "a b", "tags": ["x", "y", {"deep": [1, 2.5, null]}], "on": true, "none": null, "sub": {"one": {"two": "z"}}}'


def doc_lookup(spark, sf_dir):
    """First row of an id wins, also where ids repeat."""
    return docstore.first_rows(documents(spark, sf_dir).select("doc_id", "source", "text"), "doc_id", ["source", "text"])


def filemap_resolve(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("url").alias("name"))
    return docstore.resolved_names(documents(spark, sf_dir).select("doc_id"), names)


def _registry(spark, sf_dir) -> DataFrame:
    """Paths as two segments know them: every page, and pages again by the host of their url."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("s"), F.col("page_id") % 3).alias("segment"), F.regexp_replace("url", "[0-9]+", "").alias("path"))


def names_dedupe(spark, sf_dir):
    return docstore.registered_names(_registry(spark, sf_dir).distinct())


def names_repeated(spark, sf_dir):
    return docstore.repeated_names(_registry(spark, sf_dir)).select("path", "n", F.array_join("segments", ",").alias("segments"))


def names_new(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("path"))
    return docstore.new_paths(documents(spark, sf_dir).select(F.col("doc_id").alias("path")), known)


def crawl_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return readers.crawled_pages(pages).select("page_id", "url", F.octet_length("html").alias("bytes"))


def ascii_sanitize(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.ascii_for_store(F.col("text")).alias("stored"), F.length(T.ascii_for_index(F.col("text"))).alias("indexed_chars"))


def framed_source(spark, sf_dir):
    """All documents framed as one stream a source, and read back."""
    docs = documents(spark, sf_dir).where("text IS NOT NULL AND trim(text) <> ''")
    frame = F.concat(F.lit("filename d "), F.col("doc_id").cast("string"), F.lit(" /endfilename file "), F.translate("text", "/", " "), F.lit(" /endfile"))
    streams = docs.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", frame.alias("t")))), lambda x: x.getField("t")), "\n").alias("value"))
    return readers.framed_documents(streams).select("doc_id", "name", F.length("text").alias("chars"))


def query_words(spark, sf_dir):
    """Words of benchmark items as a user might type them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = T.split_query(F.regexp_replace("text", "[^A-Za-z ]", ""))
    return items.select("item_id", F.array_join(words, "+").alias("terms"), F.size(T.clean_query(words, True)).alias("kept"))


def _events_json(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")


def json_flatten(spark, sf_dir):
    return paths.flattened_json(_events_json(spark, sf_dir), "event_id", "props")


def _talks(spark, sf_dir) -> DataFrame:
    """A nested document for each conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = F.struct("turn", "role", F.length("text").alias("chars"))
    return turns.groupBy("conv_id").agg(F.to_json(F.struct(F.lit("talk").alias("kind"), F.array_sort(F.collect_list(turn)).alias("turns"))).alias("body"))


def json_nested(spark, sf_dir):
    return paths.flattened_json(_talks(spark, sf_dir), "conv_id", "body")


def json_roundtrip(spark, sf_dir):
    """Taken apart and rebuilt: every leaf a string, arrays objects of indexes."""
    flat = paths.flattened_json(_talks(spark, sf_dir), "conv_id", "body")
    return paths.rebuilt_json(flat.withColumn("value", paths.as_text(F.col("kind"), F.col("s"), F.col("n"))), "conv_id")


def json_pointer(spark, sf_dir):
    flat = paths.under(paths.flattened_json(_talks(spark, sf_dir), "conv_id", "body"), "/user/talk")
    return paths.read_json(flat, "/user/talk/turns/0/role", "conv_id")


def json_valid(spark, sf_dir):
    return paths.is_valid_json(paths.flattened_json(_events_json(spark, sf_dir), "event_id", "props"), "event_id")


def json_values_named(spark, sf_dir):
    return paths.values_named(_talks(spark, sf_dir), "conv_id", "body", "role")


def _customer_paths(spark, sf_dir) -> DataFrame:
    """Customers as paths: /nation/<key>/<customer>/<column>/."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cells = F.array(F.struct(F.lit("name").alias("c"), F.col("c_name").alias("v")), F.struct(F.lit("segment").alias("c"), F.col("c_mktsegment").alias("v")), F.struct(F.lit("home/nation").alias("c"), F.col("c_nationkey").cast("string").alias("v")))
    base = F.concat(F.lit("/nation"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit("/"))
    return c.select(base.alias("base"), F.explode(cells).alias("x")).select(F.concat("base", "x.c", F.lit("/")).alias("path"), F.col("x.v").alias("value"))


def path_range_scan(spark, sf_dir):
    return paths.range_scan(_customer_paths(spark, sf_dir), "/nation1/")


def path_range_scan_strict(spark, sf_dir):
    return paths.range_scan(_customer_paths(spark, sf_dir), "/nation1/", strict=True)


def tuple_assemble(spark, sf_dir):
    return paths.tuple_table(_customer_paths(spark, sf_dir), "/nation1/", ["name", "segment", "home/nation"])


STATEMENT = "SELECT DISTINCT n_regionkey, n_nationkey + n_regionkey * 2 + 1 AS mixed, int(n_nationkey) AS k FROM (SELECT n_nationkey, n_regionkey FROM nation) AS inside WHERE (n_nationkey >= 3 AND NOT n_regionkey == 2)"


def select_subset(spark, sf_dir):
    return select.run(STATEMENT, {"nation": spark.read.parquet(f"{sf_dir}/nation.parquet")})


def select_over_paths(spark, sf_dir):
    """The dialect over rows put together from paths."""
    table = _customer_paths(spark, sf_dir)
    return select.run("SELECT name, segment AS market FROM /nation1/ WHERE segment >= name", lambda name, columns: paths.tuple_table(table, name, sorted(columns)))


# versions: each order is a write to its customer's key; a transaction a customer and year, some of them not committed


def _writes(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(F.col("o_orderkey") % 17 == 0, "D").when(F.col("o_orderkey") % 3 == 0, "S").otherwise("N")
    return o.select(
        F.concat(F.lit("/cust"), (F.col("o_custkey") % 10).cast("string"), F.lit("/"), F.col("o_custkey").cast("string")).alias("key"),
        kind.alias("kind"),
        F.when(kind == "S", F.col("o_orderpriority")).alias("s"),
        F.when(kind == "N", F.col("o_totalprice")).alias("n"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("ts"),
        F.col("o_orderkey").alias("op"),
        F.col("o_orderkey").alias("txn_id"),
    )


def _txns(writes: DataFrame) -> DataFrame:
    return writes.select("txn_id", "ts", F.when(F.col("txn_id") % 11 == 0, "A").when(F.col("txn_id") % 13 == 0, "P").otherwise("C").alias("status"))


def _versions(spark, sf_dir) -> DataFrame:
    w = _writes(spark, sf_dir)
    return temporal.version_chain(temporal.committed(w, _txns(w)))


AS_OF = 10300


def abort_repair(spark, sf_dir):
    w = _writes(spark, sf_dir)
    return temporal.committed(w, _txns(w)).groupBy("key").agg(F.count(F.lit(1)).alias("writes"), F.max("ts").alias("last_ts"))


def version_chain(spark, sf_dir):
    return _versions(spark, sf_dir)


def snapshot_read(spark, sf_dir):
    return temporal.snapshot(_versions(spark, sf_dir), AS_OF)


def snapshot_range(spark, sf_dir):
    return temporal.snapshot_range(_versions(spark, sf_dir), "/cust3/", AS_OF)


def as_of_read(spark, sf_dir):
    """For every customer, what its key held on each of two days."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("/cust"), (F.col("c_custkey") % 10).cast("string"), F.lit("/"), F.col("c_custkey").cast("string")).alias("key"))
    reads = c.select("key", F.explode(F.array(F.lit(AS_OF - 400).cast("long"), F.lit(AS_OF).cast("long"))).alias("ts"))
    return temporal.as_of_join(reads, _versions(spark, sf_dir))


def _wal(spark, sf_dir) -> DataFrame:
    w = _writes(spark, sf_dir).withColumn("op_name", F.lit("Write"))
    op = F.struct("op", F.struct(F.col("op_name").alias("op"), "key", "kind", "s", "n").alias("w"))
    return w.groupBy("ts").agg(F.array_sort(F.collect_list(op)).alias("o")).select(F.col("ts").alias("timestamp"), F.col("o.w").alias("ops"))


def wal_replay(spark, sf_dir):
    """Written as a log, read back and applied."""
    path = new_path(spark, "wal")
    readers.write_wal(_wal(spark, sf_dir), path)
    return temporal.replayed(readers.read_wal(spark, path))


def replica_diff(spark, sf_dir):
    """A replica that has missed the orders of the last days."""
    w = _writes(spark, sf_dir)
    whole = temporal.snapshot(temporal.version_chain(w), 0)
    late = temporal.snapshot(temporal.version_chain(w.where(F.col("ts") < AS_OF)), 0)
    return temporal.differences(whole, late)


def unique_index(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"))
    return temporal.repeated_values(c).select("value", "n", F.array_join("keys", ",").alias("keys"))


def rejected_writes(spark, sf_dir):
    """Events in order of arrival as reads and writes of their users, by the value's tens as time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 10).cast("long").alias("ts"), F.when(F.col("event_id") % 2 == 0, "Read").otherwise("Write").alias("op"))
    return temporal.rejected_writes(log)


def phantom_inserts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    keys = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("key"), (F.col("c_custkey") % 50).alias("last_read"))
    inserts = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("key"), (F.col("c_nationkey") * 2).cast("long").alias("ts"))
    return temporal.phantom_inserts(keys, inserts)


QUERIES = {
    f.__name__: f
    for f in (
        doc_lookup, filemap_resolve, names_dedupe, names_repeated, names_new, crawl_filter, ascii_sanitize, framed_source, query_words, json_flatten, json_nested, json_roundtrip, json_pointer,
        json_valid, json_values_named, path_range_scan, path_range_scan_strict, tuple_assemble, select_subset, select_over_paths, abort_repair, version_chain, snapshot_read, snapshot_range,
        as_of_read, wal_replay, replica_diff, unique_index, rejected_writes, phantom_inserts,
    )
}

_REGISTRY = "reg AS (SELECT 's' || (page_id % 3) AS segment, regexp_replace(url, '[0-9]+', '', 'g') AS path FROM pages)"
_TALK = "talks AS (SELECT conv_id, list(t.turn ORDER BY t.turn) AS turns, list(t.role ORDER BY t.turn) AS roles, list(length(t.text) ORDER BY t.turn) AS chars, count(*) AS n FROM conversations t GROUP BY conv_id)"
_FLAT = f"""{_TALK}, cells AS (SELECT conv_id, unnest(range(n)) AS i, unnest(turns) AS turn, unnest(roles) AS role, unnest(chars) AS chars FROM talks)"""
_CUST = """cust AS (SELECT '/nation' || c_nationkey || '/' || c_custkey || '/' AS base, * FROM customer),
cells AS (SELECT base || 'name/' AS path, c_name AS value FROM cust UNION ALL SELECT base || 'segment/', c_mktsegment FROM cust UNION ALL SELECT base || 'home/nation/', c_nationkey::VARCHAR FROM cust)"""
_WRITES = """writes AS (SELECT '/cust' || (o_custkey % 10) || '/' || o_custkey AS key, CASE WHEN o_orderkey % 17 = 0 THEN 'D' WHEN o_orderkey % 3 = 0 THEN 'S' ELSE 'N' END AS kind,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0 THEN o_orderpriority END AS s, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 3 <> 0 THEN o_totalprice END AS n,
  (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS ts, o_orderkey AS op FROM orders),
done AS (SELECT * FROM writes WHERE op % 11 <> 0 AND op % 13 <> 0)"""


def _chain(of: str = "done") -> str:
    return f"""{_WRITES}, last AS (SELECT * FROM {of} QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY op DESC) = 1),
versions AS (SELECT key, kind, s, n, ts AS begin_ts, coalesce(lead(ts) OVER (PARTITION BY key ORDER BY ts), {temporal.FOREVER}) AS end_ts FROM last)"""


_SNAP = "SELECT key, kind, s, n FROM (SELECT * FROM versions WHERE begin_ts <= {at} QUALIFY row_number() OVER (PARTITION BY key ORDER BY begin_ts DESC) = 1) WHERE kind <> 'D'"
_LATEST = "SELECT key, kind, s, n FROM (SELECT * FROM {of} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, op DESC) = 1) WHERE kind <> 'D'"

ORACLES = {
    "doc_lookup": "SELECT doc_id, arg_min(source, (source, text)) AS source, arg_min(text, (source, text)) AS text FROM documents GROUP BY doc_id",
    "filemap_resolve": "SELECT d.doc_id, coalesce(p.name, 'File not found') AS name FROM documents d LEFT JOIN (SELECT page_id, min(url) AS name FROM pages GROUP BY page_id) p ON p.page_id = d.doc_id",
    "names_dedupe": f"WITH {_REGISTRY} SELECT min(segment) AS segment, path FROM reg GROUP BY path",
    "names_repeated": f"WITH {_REGISTRY} SELECT path, count(*) AS n, string_agg(DISTINCT segment, ',' ORDER BY segment) AS segments FROM reg GROUP BY path HAVING count(*) > 1",
    "names_new": "SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)",
    "crawl_filter": "SELECT page_id, url, strlen(html)::INT AS bytes FROM pages WHERE strlen(html) < 100000000",
    "ascii_sanitize": r"""SELECT doc_id, regexp_replace(text, '["\\]|[^\x00-\x7F]', '', 'g') AS stored, length(text)::INT AS indexed_chars FROM documents""",
    "framed_source": r"""SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_id, 'd' || doc_id AS name, length(trim(regexp_replace(replace(text, '/', ' '), '[ \t\n\r\f\v]+', ' ', 'g')))::INT AS chars FROM documents WHERE trim(text) <> ''""",
    "query_words": f"""SELECT item_id, coalesce(array_to_string(ws, '+'), '') AS terms, len(list_filter(ws, lambda w: length(w) > 2 AND NOT list_contains([{', '.join(f"'{w}'" for w in sorted(T.STOP_WORDS))}], w)))::INT AS kept
FROM (SELECT item_id, list_filter(string_split(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' '), lambda w: w <> '') AS ws FROM benchmark)""",
    "json_flatten": """SELECT event_id, CASE WHEN t.type = 'OBJECT' THEN '/' ELSE replace(replace(t.fullkey, '$', ''), '.', '/') || '/' END AS path,
  CASE WHEN t.type = 'OBJECT' OR t.type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, CASE WHEN t.type = 'OBJECT' THEN 'object-type-placeholder' WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' END AS s,
  CASE WHEN t.type NOT IN ('OBJECT', 'VARCHAR') THEN t.atom::VARCHAR::DOUBLE END AS n FROM events, json_tree(props::JSON) t""",
    "json_nested": f"""WITH {_FLAT}
SELECT conv_id, '/' AS path, 'string' AS kind, 'object-type-placeholder' AS s, NULL::DOUBLE AS n FROM talks UNION ALL SELECT conv_id, '/kind/', 'string', 'talk', NULL FROM talks
UNION ALL SELECT conv_id, '/turns/length/', 'number', NULL, n::DOUBLE FROM talks UNION ALL SELECT conv_id, '/turns/' || i || '/', 'string', 'object-type-placeholder', NULL FROM cells
UNION ALL SELECT conv_id, '/turns/' || i || '/turn/', 'number', NULL, turn::DOUBLE FROM cells UNION ALL SELECT conv_id, '/turns/' || i || '/role/', 'string', role, NULL FROM cells
UNION ALL SELECT conv_id, '/turns/' || i || '/chars/', 'number', NULL, chars::DOUBLE FROM cells""",
    "json_roundtrip": f"""WITH {_FLAT}, one AS (SELECT conv_id, string_agg('"' || i || '":{{"chars":"' || chars || '","role":"' || role || '","turn":"' || turn || '"}}', ',' ORDER BY i::VARCHAR) AS body, count(*) AS n FROM cells GROUP BY conv_id)
SELECT conv_id, '{{"kind":"talk","turns":{{' || body || ',"length":"' || n || '"}}}}' AS json FROM one""",
    "json_pointer": f"WITH {_TALK} SELECT conv_id, roles[1] AS json FROM talks",
    "json_valid": "SELECT event_id, props::JSON <> '{}'::JSON AS valid FROM events",
    "json_values_named": "SELECT conv_id, role AS value FROM conversations",
    "path_range_scan": f"WITH {_CUST} SELECT path, value FROM cells WHERE path BETWEEN '/nation1' || chr(1) AND '/nation1~'",
    "path_range_scan_strict": f"WITH {_CUST} SELECT path, value FROM cells WHERE starts_with(path, '/nation1/')",
    "tuple_assemble": """SELECT c_custkey::VARCHAR AS row_key, c_name AS name, c_mktsegment AS segment, c_nationkey::VARCHAR AS "home/nation" FROM customer WHERE c_nationkey = 1""",
    "select_subset": "SELECT DISTINCT n_regionkey, n_nationkey + (n_regionkey * (2 + 1)) AS mixed, n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey >= 3 AND n_regionkey <> 2",
    "select_over_paths": "SELECT c_name AS name, c_mktsegment AS market FROM customer WHERE c_nationkey = 1 AND c_mktsegment >= c_name",
    "abort_repair": f"WITH {_WRITES} SELECT key, count(*) AS writes, max(ts) AS last_ts FROM done GROUP BY key",
    "version_chain": f"WITH {_chain()} SELECT * FROM versions",
    "snapshot_read": f"WITH {_chain()} {_SNAP.format(at=AS_OF)}",
    "snapshot_range": f"WITH {_chain()} SELECT * FROM ({_SNAP.format(at=AS_OF)}) WHERE key BETWEEN '/cust3' || chr(1) AND '/cust3~'",
    "as_of_read": f"""WITH {_chain()}, reads AS (SELECT '/cust' || (c_custkey % 10) || '/' || c_custkey AS key, unnest([{AS_OF - 400}, {AS_OF}])::BIGINT AS ts FROM customer),
got AS (SELECT r.key, r.ts, v.kind, v.s, v.n FROM reads r ASOF LEFT JOIN versions v ON r.key = v.key AND r.ts >= v.begin_ts)
SELECT key, ts, CASE WHEN kind <> 'D' THEN kind END AS kind, CASE WHEN kind <> 'D' THEN s END AS s, CASE WHEN kind <> 'D' THEN n END AS n FROM got""",
    "wal_replay": f"WITH {_WRITES} {_LATEST.format(of='writes')}",
    "replica_diff": f"""WITH {_WRITES}, whole AS ({_LATEST.format(of='writes')}), late AS ({_LATEST.format(of=f'(SELECT * FROM writes WHERE ts < {AS_OF})')})
SELECT *, 'left' AS side FROM (SELECT * FROM whole EXCEPT ALL SELECT * FROM late) UNION ALL SELECT *, 'right' FROM (SELECT * FROM late EXCEPT ALL SELECT * FROM whole)""",
    "unique_index": "SELECT c_nationkey || '-' || c_mktsegment AS value, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys FROM customer GROUP BY 1 HAVING count(*) > 1",
    "rejected_writes": """WITH log AS (SELECT user_id AS key, event_id AS seq, floor(value / 10)::BIGINT AS ts, event_id % 2 = 0 AS is_read FROM events),
seen AS (SELECT *, max(CASE WHEN is_read THEN ts END) OVER w AS r, max(CASE WHEN NOT is_read THEN ts END) OVER w AS x FROM log WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, seq, ts, CASE WHEN r > ts THEN 'read later' ELSE 'written later' END AS reason FROM seen WHERE NOT is_read AND (r > ts OR x > ts)""",
    "phantom_inserts": """WITH keys AS (SELECT c_name AS key, c_custkey % 50 AS last_read FROM customer WHERE c_custkey % 3 <> 0), ins AS (SELECT DISTINCT c_name AS key, (c_nationkey * 2)::BIGINT AS ts FROM customer WHERE c_custkey % 3 = 0),
near AS (SELECT i.key, i.ts, arg_max(k.last_read, k.key) FILTER (WHERE k.key < i.key) AS b, arg_min(k.last_read, k.key) FILTER (WHERE k.key > i.key) AS a FROM ins i, keys k GROUP BY i.key, i.ts)
SELECT key, ts FROM near WHERE b > ts OR a > ts""",
}
