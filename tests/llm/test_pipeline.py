"""The whole pipeline against plain loops over the same few documents."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import catalog, decontaminate, sentencepiece_sampling, simhash
from quillspark.llm.kernels import chunks, mix64
from tests.llm.test_dedup import brute_groups, prose

ITEM = "when Hanna sold 30 pears to Otto for 12 dollars she had left only some pears and then walked home with them"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(rng):
    rows = []
    for i in range(40):
        rows.append((i, prose(rng, 120), "en" if i % 2 else "de"))
    rows += [(50, rows[3][1], "en"), (51, rows[3][1], "en"), (2000, rows[4][1], "de")]
    words = rows[7][1].split()
    words[50] = "changed"
    rows += [(52, " ".join(words), "en"), (53, None, "en"), (54, "", "de"), (55, "12 34 !!", "en"), (56, "!!", None)]
    rows += [(57, f"{rows[8][1]} {ITEM} {prose(rng, 40)}", "en"), (58, f"{prose(rng, 60)} {ITEM.replace('Hanna', 'Klara').replace('30', '44').replace('Otto', 'Egon')} {prose(rng, 30)}", "de")]
    rows += [(59, prose(rng, 20_000), "en"), (60, "short one", "en")]
    rng.shuffle(rows)
    return rows


def contaminated(text):
    def readings(t):
        c = next(chunks(pa.array([t])))
        found = decontaminate.tokens(c)
        for r in (decontaminate.plain(found), decontaminate.template(found, c.data, False), decontaminate.template(found, c.data, True)):
            yield list(zip(r.kind.tolist(), r.value.tolist(), r.code.tolist(), strict=True))

    size = decontaminate.WINDOW
    items, docs = list(readings(ITEM)), list(readings(text))
    for item, doc in [(items[0], docs[0]), *((x, y) for x in items[1:] for y in docs[1:])]:
        for a in range(len(doc) - size + 1):
            for b in range(len(item) - size + 1):
                x, y = doc[a : a + size], item[b : b + size]
                if [c for _, _, c in x] == [c for _, _, c in y] and sum(k == 0 for k, _, _ in y) >= size / 2:
                    pairs = {(k, v, w) for (k, v, _), (_, w, _) in zip(y, x, strict=True) if k}
                    if len({p[:2] for p in pairs}) == len(pairs) == len({(k, w) for k, _, w in pairs}):
                        return True
    return False


def test_pipeline_gives_what_plain_loops_give(spark, tmp_path):
    rows = documents(random.Random(11))
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    first = defaultdict(lambda: 10**9)
    for i, t in left:
        first[t] = min(first[t], i)
    left = [(i, t) for i, t in left if first[t] == i]
    left = [(i, t) for (i, t), (_, group, _, _) in zip(left, brute_groups(left, simhash.RADIUS), strict=True) if group == i]
    assert {50, 51, 52, 2000, 53, 54, 55, 56} & {i for i, _ in left} == set()
    left = [(i, t) for i, t in left if not contaminated(t)]
    assert {57, 58} & {i for i, _ in left} == set() and {59, 60} <= {i for i, _ in left} and len(left) >= 35

    seeds = dict(spark.createDataFrame([(i,) for i, _ in left], "i long").select("i", F.xxhash64("i", F.lit(0))).collect())
    store = sentencepiece_sampling.Store(sentencepiece_sampling.Lattices(sentencepiece_sampling.Vocabulary.load()))
    expected = {}
    for i, t in left:
        s = sentencepiece_sampling.sample(sentencepiece_sampling.Batch(next(chunks(pa.array([t]))), store), 1, mix64(np.array([seeds[i]], dtype=np.int64).view(np.uint64)), sentencepiece_sampling.SAMPLES)
        ends = np.cumsum(s.count)
        expected |= {(i, int(r)): s.ids[e - n : e].tolist() for r, e, n in zip(s.rank, ends, s.count, strict=True)}

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r["rank"]): r.ids for r in found} == expected
    assert len(found) == len(expected) and all(r.decodes for r in found)


def test_stages_keep_the_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words are here", "en", "s", 19), (2, None, None, None, None)], COLUMNS)
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    assert [r.doc_id for r in docs.collect()] == [1]
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_catalog_has_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
