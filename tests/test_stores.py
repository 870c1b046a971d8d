from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import paths as P
from quillspark.operators import docstore, paths, phrase, temporal
from quillspark.plans import select
from quillspark.queries.stores import NESTED
from quillspark.sources import readers
from quillspark.storage import new_path
from quillspark.streaming import incremental


def stringified(x):
    if isinstance(x, dict):
        return {k: stringified(v) for k, v in x.items()}
    if isinstance(x, list):
        return {str(i): stringified(v) for i, v in enumerate(x)} | {"length": str(len(x))}
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x)


def round_trip(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d) if not isinstance(d, str) else d) for i, d in enumerate(docs)], "i long, j string")
    flat = paths.flattened_json(df, "i", "j")
    back = paths.rebuilt_json(flat.withColumn("value", paths.as_text(F.col("kind"), F.col("s"), F.col("n"))), "i")
    return {r.i: json.loads(r.json) for r in back.collect()}, flat


def test_json_round_trip(spark):
    rng = random.Random(4)

    def nested(depth):
        return {f"k{rng.randrange(99)}": nested(depth - 1) if depth and rng.random() < 0.4 else f"{rng.getrandbits(32):x} \"q\" é" for _ in range(rng.randrange(1, 6))}

    docs = [json.loads(NESTED), {"a": 1}, {"nested_arr": [1, "x", None, {"y": [True]}]}] + [nested(4) for _ in range(15)]
    found, _ = round_trip(spark, docs)
    assert found == {i: stringified(d) for i, d in enumerate(docs)}


def test_json_flatten_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "not json"), (3, "5"), (4, "{}"), (5, "[]"), (6, '{"a": {}}')], "i long, j string")
    rows = {(r.i, r.path): (r.kind, r.s, r.n) for r in paths.flattened_json(df, "i", "j").collect()}
    assert rows == {
        (3, "/"): ("number", None, 5.0), (4, "/"): ("string", paths.OBJECT, None), (5, "/length/"): ("number", None, 0.0),
        (6, "/"): ("string", paths.OBJECT, None), (6, "/a/"): ("string", paths.OBJECT, None),
    }
    valid = {r.i: r.valid for r in paths.is_valid_json(paths.flattened_json(df, "i", "j"), "i").collect()}
    assert valid == {3: True, 4: False, 5: True, 6: False}
    assert paths.flattened_json(df.limit(0), "i", "j").count() == 0


def test_json_pointer_and_named_values(spark):
    df = spark.createDataFrame([(1, '{"uri": "x", "in": [{"uri": "y"}, {"other": {"uri": "z"}}]}'), (2, '{"no": 1}')], "i long, j string")
    assert sorted((r.i, r.value) for r in paths.values_named(df, "i", "j").collect()) == [(1, "x"), (1, "y"), (1, "z")]
    held = paths.under(paths.flattened_json(df, "i", "j"), "/user/d")
    got = {r.i: r.json for r in paths.read_json(held, "user/d/in/0/uri", "i").collect()}
    assert got == {1: "y", 2: None}


def test_path_ranges(spark):
    names = ["/test/", "/test/1", "/testing", "/test-x", "/test", "/tesu", "/other"]
    df = spark.createDataFrame([(n, "v") for n in names], "path string, value string")
    assert {r.path for r in paths.range_scan(df, "/test/").collect()} == {"/test/", "/test/1", "/testing", "/test-x"}
    assert {r.path for r in paths.range_scan(df, "/test/", strict=True).collect()} == {"/test/", "/test/1"}
    with pytest.raises(ValueError):
        paths.range_scan(df, "/test")
    row = df.limit(1).select(P.parts(F.lit("/a/b/")), P.from_parts(F.array(F.lit("a"), F.lit("b"))), P.joined(F.lit("/a/"), F.lit("b")), P.closed(F.lit("/a"))).first()
    assert list(row) == [["a", "b"], "/a/b/", "/a/b", "/a/"]


def test_tuples(spark):
    rows = [("/user1/id/", "1"), ("/user1/tele/", "5"), ("/user2/id/", "2"), ("/user2/deep/er/", "x"), ("/user3/none/", "n"), ("/user4/", "self")]
    df = spark.createDataFrame(rows, "path string, value string")
    every = {r.row_key: r.cells for r in paths.assembled_tuples(df, "/").collect()}
    assert every == {"user1": {"id": "1", "tele": "5"}, "user2": {"id": "2", "deep/er": "x"}, "user3": {"none": "n"}}
    some = {r.row_key: (r.id, r.tele) for r in paths.tuple_table(df, "/", ["id", "tele"]).collect()}
    assert some == {"user1": ("1", "5"), "user2": ("2", None)}


def test_versions_in_time(spark):
    store = temporal.Store(spark)
    for i in range(10):
        txn = store.begin(300000 + i)
        store.write(txn, "k", float(i))
        store.commit(txn)
    versions = store.versions()
    assert [temporal.snapshot(versions, 300000 + i).first().n for i in (0, 4, 9)] == [0.0, 4.0, 9.0]
    assert temporal.snapshot(versions, 299999).count() == 0
    assert temporal.snapshot(versions, 0).first().n == 9.0
    reads = spark.createDataFrame([("k", 300003, "a"), ("k", 1, "b"), ("z", 300003, "c")], "key string, ts long, who string")
    assert {r.who: r.n for r in temporal.as_of_join(reads, versions).collect()} == {"a": 3.0, "b": None, "c": None}


def test_aborts_and_deletes(spark):
    store = temporal.Store(spark)
    store.put("k", "first")
    for _ in range(20):
        txn = store.begin()
        store.write(txn, "k", "bad")
        store.abort(txn)
    pending = store.begin()
    store.write(pending, "k", "later")
    assert store.read().first().s == "first"
    with pytest.raises(ValueError):
        store.commit(1)
    store.put("/user/a", 1.0)
    store.put("k", None)
    assert {r.key for r in store.read().collect()} == {"/user/a"} == {r.key for r in store.read_range("/user/").collect()}


def test_log_replay_equals_the_store(spark, tmp_path):
    rng = random.Random(6)
    store, live = temporal.Store(spark), {}
    for _ in range(300):
        txn, batch = store.begin(), {}
        for _ in range(rng.randrange(1, 5)):
            key = str(rng.randrange(20))
            batch[key] = rng.choice([None, f"v{rng.random()}", rng.random()])
            store.write(txn, key, batch[key])
        if rng.random() < 0.1:
            store.abort(txn)
        else:
            store.commit(txn)
            live |= batch
    path = str(tmp_path / "wal")
    readers.write_wal(store.wal(), path)
    wal = readers.read_wal(spark, path)
    found = {r.key: r.s if r.kind == "S" else r.n for r in temporal.replayed(wal).collect()}
    assert found == {k: v for k, v in live.items() if v is not None}
    assert temporal.differences(temporal.replayed(wal), store.read()).count() == 0
    for late in (False, True):
        if late:
            readers.write_wal(spark.createDataFrame([(10**9, [("Write", "late", "S", "x", None)])], readers.WAL), path)
        incremental.replay_stream(incremental.wal_tail(spark, path), str(tmp_path / "last"), str(tmp_path / "cp")).awaitTermination()
        kept = {r.key: r.s if r.kind == "S" else r.n for r in incremental.replayed_table(spark, str(tmp_path / "last")).collect()}
        assert kept == found | ({"late": "x"} if late else {})


def test_logged_reads_are_checked(spark):
    w = lambda k, n: ("Write", k, "N", None, n)
    r = lambda k, n: ("Read", k, "N", None, n)
    wal = spark.createDataFrame([(10, [w("a", 1.0)]), (20, [r("a", 1.000001), w("a", 2.0)]), (30, [r("a", 1.0), r("b", 5.0)]), (0, [r("a", 2.0)])], readers.WAL)
    assert sorted((x.ts, x.key) for x in temporal.failed_reads(wal).collect()) == [(30, "a"), (30, "b")]


def test_phantoms_and_rejections(spark):
    keys = spark.createDataFrame([("/test/1", 50), ("/test/2", 50), ("/test/5", 50), ("/user/0", 0)], "key string, last_read long")
    inserts = spark.createDataFrame([("/test/6", 40), ("/test/0", 40), ("/test/4", 40), ("/user/4", 40), ("/test/3", 60)], "key string, ts long")
    assert {r.key for r in temporal.phantom_inserts(keys, inserts).collect()} == {"/test/6", "/test/0", "/test/4"}
    rng = random.Random(4)
    some = {f"k{rng.randrange(500):03d}": rng.choice([None, rng.randrange(90)]) for _ in range(60)}
    new = [(f"k{rng.randrange(500):03d}", rng.randrange(90)) for _ in range(300)]
    order = sorted(some)
    expected = set()
    for key, ts in new:
        near = [max((k for k in order if k < key), default=None), min((k for k in order if k > key), default=None)]
        if key not in some and any(k is not None and some[k] is not None and some[k] > ts for k in near):
            expected.add((key, ts))
    found = temporal.phantom_inserts(spark.createDataFrame(list(some.items()), "key string, last_read long"), spark.createDataFrame(new, "key string, ts long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == expected and "NestedLoop" not in plan and "SinglePartition" not in plan
    assert temporal.phantom_inserts(keys.limit(0), inserts).count() == 0 and temporal.phantom_inserts(keys, inserts.limit(0)).count() == 0
    log = spark.createDataFrame([("k", 1, 10, "Write"), ("k", 2, 30, "Read"), ("k", 3, 20, "Write"), ("k", 4, 40, "Write"), ("k", 5, 35, "Write")], "key string, seq long, ts long, op string")
    assert {(r.seq, r.reason) for r in temporal.rejected_writes(log).collect()} == {(3, "read later"), (5, "written later")}


def test_unique_values(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "key string, value string")
    assert [tuple(r) for r in temporal.repeated_values(df).collect()] == [("x", 2, ["a", "c"])]
    assert temporal.lookup(df, spark.createDataFrame([("y",)], "value string")).first().key == "b"


def test_document_store(spark):
    store = docstore.DocumentStore(spark, new_path(spark, "store"))
    store.insert(spark.createDataFrame([(1, "u1", 'say "é" \\ x'), (2, "u2", "two")], "id long, url string, contents string"))
    store.insert(spark.createDataFrame([(1, "late", "late")], "id long, url string, contents string"))
    assert [tuple(r) for r in store.get(1).collect()] == [(1, "u1", "say   x")]
    assert store.rows().count() == 2 and store.get(9).count() == 0


def test_names(spark):
    names = spark.createDataFrame([("s1", "a", 5), ("s0", "a", 4), ("s0", "b", 3)], "segment string, path string, n int")
    assert {(r.segment, r.path) for r in docstore.registered_names(names).collect()} == {("s0", "a"), ("s0", "b")}
    assert docstore.repeated_names(names).first().path == "a"
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    filemap = spark.createDataFrame([(1, "one")], "doc_id long, name string")
    assert {r.doc_id: r.name for r in docstore.resolved_names(ids, filemap).collect()} == {1: "one", 2: docstore.NOT_FOUND}
    candidates = spark.createDataFrame([("a",), ("z",)], "path string")
    assert docstore.known_paths(candidates, names).first().path == "a" and docstore.new_paths(candidates, names).first().path == "z"


def test_statements(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (2, 20), (3, 5)], "a int, b int")
    run = lambda q: sorted(tuple(r) for r in select.run(q, {"t": t}).collect())
    assert run("SELECT DISTINCT a FROM t") == [(1,), (2,), (3,)]
    assert run("SELECT 3 * 3 + 5 AS x FROM t WHERE a == 1") == [(24,)]
    assert run("select a AS one, - b AS low from (select a, b from t where b >= 10) AS s where a <= 1") == [(1, -10)]
    assert run("SELECT a FROM t WHERE (a >= 2) AND NOT (b == 5)") == [(2,), (2,)]
    assert run("SELECT a FROM t WHERE (a + b) >= 22") == [(2,), (2,)]
    assert run("SELECT bool(a) AS t, int(b) FROM t WHERE a == 3") == [(True, 5)]
    for bad in ("SELECT FROM t", "SELECT a FROM t WHERE a", "SELECT a FROM t extra", "SELECT a ; FROM t", "SELECT f(a) FROM t", "SELECT a, FROM t", ""):
        with pytest.raises(select.SyntaxProblem):
            select.run(bad, {"t": t})


def test_sources(spark, tmp_path):
    stream = spark.createDataFrame([("filename a b /endfilename file one\n two   three /endfile filename c /endfilename file  /endfile filename d /endfilename file x /endfile /endindexing filename e /endfilename file y /endfile",)], "value string")
    assert [tuple(r) for r in readers.framed_documents(stream).orderBy("doc_id").collect()] == [(0, "ab", "one two three"), (1, "c", ""), (2, "d", "x")]
    assert [tuple(r) for r in readers.fuzzed_documents(spark.createDataFrame([(" a  b ",)], "value string")).collect()] == [(3, "a"), (3, "b")]
    lines = spark.createDataFrame([("# joined x",), ("",), ("seg",)], "value string")
    assert [r.segment for r in readers.catalogued_segments(lines).collect()] == ["seg"]
    pages = spark.createDataFrame([(200, "text/html; x", "<p>"), (404, "text/html", "<p>"), (200, "image/png", "x"), (200, "text/html", None)], "status int, type string, html string")
    assert readers.crawled_pages(pages, "html", "status", "type").count() == 1
    for name, text in (("a.txt", "alpha"), ("b.txt", "beta"), ("c.txt", "gamma")):
        (tmp_path / name).write_text(text)
    (tmp_path / "listing").write_text("a.txt\nb.txt\nc.txt\n")
    files = lambda **kw: [tuple(r) for r in readers.listed_files(spark, str(tmp_path / "listing"), str(tmp_path), **kw).orderBy("doc_id").collect()]
    assert files() == [(1, 0, "a.txt", "alpha"), (2, 0, "b.txt", "beta"), (3, 0, "c.txt", "gamma")]
    assert [r[1] for r in files(most_files=2)] == [0, 0, 1] and [r[1] for r in files(most_bytes=5)] == [0, 1, 1] and [r[1] for r in files(most_bytes=1)] == [0, 1, 2]
    (tmp_path / "listing").write_text("none.txt\n\na.txt\n")
    assert files() == [(2, 0, "a.txt", "alpha")]


def test_stream_of_documents(spark, tmp_path):
    from quillspark.operators import index

    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, f"common word{'abc'[k]} text") for i in range(5)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    path = new_path(spark, "stream")
    incremental.index_stream(stream, path, str(tmp_path / "cp")).awaitTermination()
    held = index.open_index(spark, path)
    assert held.terms.select("segment").distinct().count() == 3
    whole = index.build(spark.read.parquet(source))
    assert held.postings.drop("segment").exceptAll(whole.postings.drop("segment")).count() == 0
    assert held.postings.count() == whole.postings.count()


def test_no_frame_is_read_again_for_each_row(spark):
    keys = spark.range(0, 3000, 3).selectExpr("format_string('k%05d', id) AS key", "id % 50 AS last_read")
    inserts = spark.range(1, 3000, 3).selectExpr("format_string('k%05d', id) AS key", "id % 40 AS ts")
    found = temporal.phantom_inserts(keys, inserts)
    places = spark.createDataFrame([("s", t, d, p) for d in range(3) for p, t in enumerate("ABBA")], "segment string, term string, doc_id long, pos int")
    for df in (found, phrase.pair_gaps(places, ["A", "B"])):  # a frame up to the end of its partition costs the square of its rows
        assert not re.search(r"(?<!unboundedpreceding\$\(\), )unboundedfollowing", df._jdf.queryExecution().optimizedPlan().toString())
    expected = {(f"k{i:05d}", i % 40) for i in range(1, 3000, 3) if (i - 1) % 50 > i % 40 or (i + 2 < 3000 and (i + 2) % 50 > i % 40)}
    assert {tuple(r) for r in found.collect()} == expected
