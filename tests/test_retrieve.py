from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import expand, highlight, index, match, phrase
from quillspark.plans.retrieve import retrieve, retrieve_exact
from quillspark.storage import new_path


def words(rng, n):
    return " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randrange(2, 14))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    """Document i has a word if 4, 5 or 7 divide i."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        marks = [w for k, w in ((4, "TESTWORD"), (5, "YESTWORDONE"), (7, "UESTWORDTWO")) if i % k == 0]
        rows.append((i, f"{words(rng, 8)} fddsvc fewivx vncms {' '.join(marks)} {words(rng, 8)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, index.write_index(docs, new_path(spark, "planted"))


def test_planted_terms_are_found(spark, planted):
    _, held = planted
    for term in ("FDDSVC", "FEWIVX", "VNCMS"):
        assert retrieve(held, [term]).results.count() == 300
    assert retrieve(held, ["QQQQQZZZZZ"]).results.where("score > 100").count() == 0
    assert retrieve_exact(held, "DOES;NOT").count() == 0


def test_all_terms_is_the_intersection(planted):
    _, held = planted
    found = retrieve(held, ["TESTWORD", "YESTWORDONE", "UESTWORDTWO"]).results
    assert {r.doc_id for r in found.collect()} >= {0, 140, 280}
    exact = retrieve(held, ["TESTWORD", "YESTWORDONE", "UESTWORDTWO"], window="prefix").results
    assert {r.doc_id for r in exact.collect()} == {0, 140, 280}


def test_all_is_within_any_and_fallback(planted):
    _, held = planted
    every = {r.doc_id for r in retrieve(held, ["TESTWORD", "YESTWORDONE"], window="prefix").results.collect()}
    some = {r.doc_id for r in retrieve(held, ["TESTWORD", "YESTWORDONE"], "or", "prefix").results.collect()}
    assert every < some
    fallback = retrieve(held, ["TESTWORD", "QXQXQXQX"], "and_or_fallback", "prefix").results
    assert {r.doc_id for r in fallback.collect()} == {i for i in range(300) if i % 4 == 0}
    with pytest.raises(ValueError):
        retrieve(held, [])
    with pytest.raises(ValueError):
        retrieve(held, ["A"], "xor")


def test_terms_found_on_the_driver_are_those_of_the_plan(spark, planted):
    docs, _ = planted
    held = index.write_index(docs.withColumn("seg", F.col("doc_id") % 3), new_path(spark, "driver"), "seg")
    vocabulary = [r.term for r in held.terms.select("term").distinct().limit(40).collect()]
    for window in ("stub", "prefix"):
        for terms in (["TESTWORD", "FDDSVC"], ["A"], ["ZZZZZZ", "AAA"], ["TES", "YEST", "Q"], [t[: 3 + k % 4] for k, t in enumerate(vocabulary)]):
            plan = expand.expanded_terms(held, expand.query_terms(spark, terms), window)
            assert sorted(expand.answered_terms(held, terms, window)) == sorted(tuple(r) for r in plan.collect())
    assert expand.answered_terms(held.of("0"), ["A"]) is None


def test_score_merges(spark):
    scores = spark.createDataFrame([("s", 0, d, 1) for d in (2, 10, 11)] + [("s", 1, d, 1) for d in (0, 1, 2, 9, 10, 11)], "segment string, qpos int, doc_id long, score long")
    assert {r.doc_id: r.score for r in match.match_any(scores).collect()} == {0: 1, 1: 1, 2: 2, 9: 1, 10: 2, 11: 2}
    assert {r.doc_id: r.score for r in match.match_all(scores, 2).collect()} == {2: 2, 10: 2, 11: 2}  # 2.6, cut
    assert match.match_all(scores, 3).count() == 0
    assert match.match_all(scores.where("qpos = 0"), 1).count() == 3


def test_random_lists_intersect(spark):
    rng = random.Random(3)
    lists = [{rng.randrange(2000) for _ in range(1500)} for _ in range(4)]
    df = spark.createDataFrame([("s", q, d, 10) for q, x in enumerate(lists) for d in x], "segment string, qpos int, doc_id long, score long")
    assert {r.doc_id for r in match.match_all(df, 4).collect()} == set.intersection(*lists)


def test_merging_segments_is_building_at_once(spark, planted):
    docs, _ = planted
    parts = index.build(docs.withColumn("seg", F.concat(F.lit("p"), F.col("doc_id") % 3)), "seg")
    merged = index.merge_segments(parts, ["p0", "p1", "p2"], "0")
    once = index.build(docs)
    assert merged.terms.exceptAll(once.terms).count() == 0 and once.terms.exceptAll(merged.terms).count() == 0
    assert merged.postings.exceptAll(once.postings).count() == 0
    assert index.inconsistencies(merged).count() == 0


def test_compaction_leaves_few_segments(spark, planted):
    docs, _ = planted
    path = new_path(spark, "many")
    held = index.write_index(docs.withColumn("seg", F.concat(F.lit("p/"), F.col("doc_id") % 10)), path, "seg")
    assert held.terms.select("segment").distinct().count() == 10
    before = {tuple(r) for r in held.positions.drop("segment").collect()}
    few = index.compact(spark, path, 4)
    assert few.terms.select("segment").distinct().count() == 4 == len(index.catalogue(spark, path)[1])
    assert {tuple(r) for r in few.positions.drop("segment").collect()} == before and index.inconsistencies(few).count() == 0
    assert len(list(Path(path.removeprefix("file://")).glob("postings/version=*/segment=*"))) == 4
    apart = index.compact(spark, path, 1, most_size=10)
    assert apart.terms.select("segment").distinct().count() == 4
    with pytest.raises(ValueError):
        index.write_index(docs.where("doc_id = 0").withColumn("seg", F.lit("p/3")), path, "seg")
    assert index.open_index(spark, path).positions.count() == len(before)


def test_segments_are_bounded_and_replaced_as_a_whole(spark, planted):
    docs, _ = planted
    path = new_path(spark, "bounded")
    held = index.write_index(docs, path, most_bytes=8_000)
    names = sorted(r.segment for r in held.terms.select("segment").distinct().collect())
    assert len(names) > 2 and all(n.startswith("0.") for n in names)
    assert held.postings.drop("segment").exceptAll(index.build(docs).postings.drop("segment")).count() == 0
    again = index.write_index(docs.where("doc_id < 5"), path, replace=True)
    assert again.terms.select("segment").distinct().count() == 1 and again.postings.select("doc_id").distinct().count() == 5


def test_what_no_catalogue_names_is_not_there(spark, planted):
    docs, _ = planted
    path = new_path(spark, "torn")
    index._write(index.grouped_terms(docs.where("doc_id < 9")), path)  # as if the writer had been lost then
    assert index.open_index(spark, path).terms.count() == 0
    held = index.write_index(docs.where("doc_id < 3"), path)
    assert held.postings.select("doc_id").distinct().count() == 3
    with pytest.raises(RuntimeError):
        index._commit(spark, path, 0, [])


def test_terms_of_batches_are_those_of_expressions(spark):
    rng = random.Random(11)
    pieces = ["the", "THE", "Word", "x", "ab", "É", "日本", "a" * 60, "B" * 51, " ", "-", "\n", "AND", "and9", "ΑΒΓ", "İ"]
    texts = ["", None, "THE", "not THE", "the a" + "z" * 55, *("".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for stop in (True, False):
        expected = {(r.doc_id, t.term, t.pos) for r in df.where("text IS NOT NULL").select("doc_id", T.tokens(F.col("text"), stop).alias("t")).collect() for t in r.t}
        assert {(r.doc_id, r.term, r.pos) for r in index.positions_of(df, stop_words=stop).collect()} == expected and expected


def test_inconsistency_is_reported(planted):
    _, held = planted
    broken = index.Index(held.terms.withColumn("cf", F.col("cf") + 1), held.postings, held.positions)
    assert {r.problem for r in index.inconsistencies(broken).collect()} == {"positions", "postings"}


def test_tiers_hold_256_by_rising_frequency(spark):
    rows = [("0", "T", d, 1 + d % 5) for d in range(600)]
    tiers = index.tier_blocks(spark.createDataFrame(rows, "segment string, term string, doc_id long, tf int")).collect()
    sizes = {}
    for r in tiers:
        sizes.setdefault(r.tier, []).append(r.tf)
    assert [len(sizes[t]) for t in sorted(sizes)] == [256, 256, 88]
    assert max(sizes[0]) <= min(sizes[1]) and max(sizes[1]) <= min(sizes[2])


def test_positions_give_the_words_back(planted):
    docs, held = planted
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in held.positions.limit(500).collect():
        assert texts[r.doc_id][r.pos : r.pos + len(r.term)].upper() == r.term


def test_phrases_rank_first(spark):
    rows = [(i, "zebrafish quickstep moonlight" if i % 3 == 0 else f"zebrafish {'pad ' * (10 + i)}quickstep {'pad ' * 20}moonlight") for i in range(1, 31)]
    held = index.build(spark.createDataFrame(rows, "doc_id long, text string"))
    ranked = retrieve(held, ["ZEBRAFISH", "QUICKSTEP", "MOONLIGHT"], window="prefix").by_phrase().orderBy(F.col("score").desc(), "doc_id").collect()
    assert [r.doc_id for r in ranked[:10]] == [i for i in range(1, 31) if i % 3 == 0]
    assert ranked[0].difference == 0


def test_pair_gaps_by_brute_force(spark):
    rng = random.Random(5)
    rows = [("s", rng.choice("AB"), d, p) for d in range(20) for p in rng.sample(range(200), rng.randrange(1, 12))]
    found = {r.doc_id: r.gap for r in phrase.pair_gaps(spark.createDataFrame(rows, "segment string, term string, doc_id long, pos int"), ["A", "B"]).collect()}
    for d in range(20):
        a, b = ([p for _, t, x, p in rows if x == d and t == w] for w in "AB")
        gaps = [y - x for x in a for y in b if y >= x]
        assert found[d] == (min(gaps) if gaps else None)


def merged(places):
    out = []
    for pos, size in sorted(places):
        if out and pos - out[-1][0] - out[-1][1] < 30:
            out[-1] = (out[-1][0], size + pos - out[-1][0])
        else:
            out.append((pos, size))
    return out


def test_spans_and_snippets(spark):
    rng = random.Random(9)
    lists = [[(rng.randrange(500), rng.randrange(3, 9)) for _ in range(rng.randrange(0, 20))] for _ in range(30)]
    text = words(rng, 200)
    df = spark.createDataFrame([(i, x, text) for i, x in enumerate(lists)], "i int, x array<struct<pos:int,len:int>>, t string")
    for r in df.select("i", highlight.merged_spans(F.col("x")).alias("s"), highlight.snippet(F.col("t"), highlight.merged_spans(F.col("x"))).alias("cut")).collect():
        spans = merged(lists[r.i])
        assert [tuple(x) for x in r.s] == spans
        shown = sorted((size, pos) for pos, size in spans)[-6:]
        assert r.cut == "...".join(text[pos : pos + size] for size, pos in shown)


def test_marked_segments_give_the_text_back(spark, planted):
    docs, held = planted
    page = retrieve(held, ["FDDSVC", "TESTWORD"]).page(docs, 5)
    got = page.join(docs, "doc_id").select("text", highlight.marked_segments(F.col("text"), F.col("matches")).alias("m")).collect()
    assert len(got) == 5
    for r in got:
        assert "".join(x.text for x in r.m) == r.text
        assert any("fddsvc" in x.text for x in r.m if x.mark)


def test_page_keeps_documents_without_spans(spark, planted):
    docs, held = planted
    page = retrieve(held, ["FDDSVC"]).page(docs, 20).collect()
    assert len(page) == 20 and [r.score for r in page] == sorted((r.score for r in page), reverse=True)


def test_joined_segments(spark):
    rng = random.Random(2)
    rows = [(f"s{s}", s * 1000 + d, rng.randrange(1, 200)) for s in range(3) for d in range(50)]
    found = {r.doc_id for r in match.joined_segments(spark.createDataFrame(rows, "segment string, doc_id long, score long")).collect()}
    kept, mean = [], 0.0
    for _, doc, score in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if len(kept) < 40 or score >= int(mean / 1.2):
            mean = (len(kept) * mean + score) / (len(kept) + 1)
            kept.append(doc)
    assert found == set(kept)


def test_plans_keep_texts_where_they_are(spark, planted):
    docs, held = planted
    found = retrieve(held, ["FDDSVC", "TESTWORD"])
    plan = found.page(docs, 5)._jdf.queryExecution().optimizedPlan().toString()
    text = next(f for f in docs._jdf.queryExecution().analyzed().output().mkString(" ").split() if f.startswith("text#"))
    physical = found.page(docs, 5)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in physical.split("\n") if "Exchange" in line and text in line and "BroadcastExchange" not in line]
    assert plan and not exchanged and "NestedLoop" not in physical and "RightOuter" not in physical


def test_builder(spark):
    builder = index.IndexBuilder(spark)
    assert builder.persist() is None
    held = builder.append_text("hello world testing earth\0hidden", 182).concat(index.IndexBuilder(spark).append_text("jumping fox", 183)).persist("one")
    assert {r.term for r in held.terms.collect()} == {"HELLO", "WORLD", "TESTING", "EARTH", "JUMPING", "FOX"}
    again = builder.append_text("hello again", 184).persist("two")
    assert {r.segment for r in again.terms.collect()} == {"one", "two"}
    assert {r.doc_id for r in retrieve(again, ["HELLO"]).results.collect()} == {182, 184}


def test_empty_index(spark):
    held = index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert retrieve(held, ["ANY", "THING"]).results.count() == 0
    assert expand.scanned_terms(held, expand.query_terms(spark, ["ANY"])).count() == 0


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_segment_is_one_whatever_its_size(spark, planted, monkeypatch):
    docs, _ = planted
    monkeypatch.setattr(index, "_input_bytes", lambda *_: 250_000_000)  # as if texts were long
    held = index.write_index(docs, new_path(spark, "large"))
    whole = index.build(docs)
    assert same(held.terms, whole.terms) and same(held.postings, whole.postings) and same(held.positions, whole.positions)
    path = new_path(spark, "large-parts")
    index.write_index(docs.withColumn("seg", F.col("doc_id") % 5), path, "seg")
    few = index.compact(spark, path, 2)
    assert few.terms.select("segment").distinct().count() == 2 and index.inconsistencies(few).count() == 0
    assert not list(Path(path.removeprefix("file://")).glob("draft-*"))


def test_terms_are_numbered_as_one_sort_numbers_them(spark):
    rng = random.Random(13)
    rows = [(s, t) for s in ("a", "b") for t in {"".join(rng.choice("ABZ") for _ in range(rng.randrange(3, 8))) for _ in range(300)} | {"ABA", "ABAB", "ABABA"}]
    found = index.numbered_terms(spark.createDataFrame([(s, t, 1, 2) for s, t in rows], "segment string, term string, df long, cf long")).collect()
    for s in ("a", "b"):
        terms = sorted(t for x, t in rows if x == s)
        assert [(r.term, r.term_ord, r.is_stub) for r in sorted((r for r in found if r.segment == s), key=lambda r: r.term)] == [(t, i, i % 10 == 0 or i == len(terms) - 1) for i, t in enumerate(terms)]


def test_no_task_of_a_write_gathers_a_term_or_a_segment(spark):
    rows = spark.range(20_000).selectExpr("'s' || (id % 3) AS segment", "id AS doc_id", "'same words here' AS text")
    sizes = [r[0] for r in index._dealt(rows, 30 * index.TASK_BYTES).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 30 and max(sizes) < 2 * 20_000 / 30


def test_stop_words_are_counted_as_tokens_are(spark):
    rng = random.Random(17)
    pieces = ["the", "THE", "Word", "x", "É", "a" * 60, "B" * 51, " ", "-", "AND", "and9", "THEMSELVES", "OURSELVESX"]
    texts = ["", None, "THE", "not THE", *("".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = {tuple(r) for r in df.where("text IS NOT NULL").select("doc_id", F.size(T.tokens(F.col("text"), False)), F.size(T.tokens(F.col("text")))).collect()}
    assert {tuple(r) for r in index.stop_word_counts(df).collect()} == expected


def test_a_page_reads_the_terms_that_it_shows(planted):
    docs, held = planted
    plan = retrieve(held, ["TESTWORD", "FDDSVC"]).page(docs, 5)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.split("\n") if "places#" in line and "PushedFilters" in line]
    assert pushed and all("TESTWORD" in line.split("PushedFilters")[1] for line in pushed)
