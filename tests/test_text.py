from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def by_hand(text: str) -> list[tuple[str, int]]:
    out = []
    for m in re.finditer("[A-Za-z]+", text):
        raw, start, last = m[0], m.start(), m.end() == len(text)
        if len(raw) > 50 and not last:
            start, raw = m.end() - 50, raw[-50:]
        if len(raw) > 2 and (last or raw not in T.STOP_WORDS):
            out.append((raw.upper(), start))
    return out


LONG = "x" * 60
TEXTS = ["", " ", "abc", "THE cat THE", "the cat", f"{LONG} end", f"end {LONG}", "a1bc;def\\ghi  jkl", "ééé word é", "𝒳 astral word", "can't stop", "\n\nline\tTHAT\n", "AND", "no" * 30 + ".", "word " * 1000]


def test_tokens_match_a_plain_loop(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abT HE\n.é") for _ in range(rng.randrange(400))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokens(F.col("t")).alias("x")).collect()
    for i, found in rows:
        assert [(x.term, x.pos) for x in found] == by_hand(texts[i]), texts[i]


def test_null_text_has_no_tokens(spark):
    assert spark.createDataFrame([(None,)], "t string").select(F.explode(T.tokens(F.col("t")))).count() == 0


@pytest.mark.parametrize("block", [1, 3, 128])
def test_running_sums(spark, block):
    lists = [[], [5], [1, 2, 3], list(range(300))]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", T.running_sums(F.col("x"), block).alias("s")).collect()
    for r in rows:
        assert r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))]


def test_stop_list_has_its_size():
    assert len(T.STOP_WORDS) == 110 and "BECAUSE" not in T.STOP_WORDS


def test_match_scores(spark):
    expected = {("TEST", "TEST"): 60.0, ("TEST", "TESTING"): 22.399999618530273, ("TESTING", "TEST"): 2.799999952316284, ("TESTER", "TESTED"): 5.0, ("CAN", "CANADIAN"): 13.999999523162842, ("WIKI", "WIKIBOOKS"): 18.66666603088379, ("", "A"): 0.0}
    rows = spark.createDataFrame(list(expected), "q string, k string").select("q", "k", T.match_score(F.col("q"), F.col("k"))).collect()
    assert {(q, k): s for q, k, s in rows} == expected


def test_posting_scores(spark):
    rows = spark.createDataFrame([(1, 60.0), (2, 60.0), (10, 60.0), (10, 22.399999618530273)], "tf int, s double").select(T.posting_score(F.col("tf"), F.col("s"))).collect()
    assert [r[0] for r in rows] == [60, 78, 120, 44]


def test_keys_sort_as_terms_do(spark):
    terms = ["A", "AA", "AAA", "AB", "B", "CAN", "CANADA", "Z", "ZZZZZZZZZZZ"]
    keys = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(T.term_key(F.col("t"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert keys[terms.index("CAN")] == 16989831196551036
    assert keys[terms.index("CANADA")] > keys[terms.index("CAN")] + T.KEY_STEP


def test_cutoff_rises_with_what_was_accepted(spark):
    scores = [4.0] * 12 + [5.0, 9.5, 9.6, 100.0, 3.0]
    n = total = 0
    expected = []
    for i, s in enumerate(scores):
        if s >= (4 if n < 12 else (total + n) // n * 1.9):
            expected.append(i)
            n, total = n + 1, int(total + s)
    df = spark.createDataFrame([([(i, "T", s) for i, s in enumerate(scores)],)], "x array<struct<term_ord:bigint,term:string,score:double>>")
    assert [k.term_ord for k in df.select(T.accepted_keys(F.col("x")).alias("k")).first().k] == expected


def test_queries_and_sanitisers(spark):
    row = spark.range(1).select(
        T.split_query(F.lit("foo+bar  the")), T.clean_query(F.array(F.lit("foo"), F.lit("of"), F.lit("the")), True), T.ascii_for_index(F.lit("aé𝒳b")), T.ascii_for_store(F.lit('a"\\éb'))
    ).first()
    assert list(row) == [["FOO", "BAR", "THE"], ["FOO"], "a??b", "ab"]
