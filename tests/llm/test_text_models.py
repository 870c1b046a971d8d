from __future__ import annotations

import itertools
import json
import math
import re
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import kernels, language, lm_scoring, sentencepiece_sampling
from quillspark.llm.kernels import chunks, mix64

SCHEMA = "doc_id long, text string, lang string, code string, bits int, _id string, _text string, n_bytes string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", "z", "w") for i, t, lang in rows], SCHEMA)


# prediction by partial matching ---


def brute_bits(fitted, texts, order, least=1):
    """Code every byte of the texts by what follows each context in the fitted ones: escapes, exclusion; what is seen less often than `least` after two bytes and more is not seen."""
    follow = defaultdict(Counter)

    def cells(t):
        data = bytes(order) + (t or "").encode()
        return [(data[p - order : p], data[p]) for p in range(order, len(data))]

    for t in fitted:
        for context, byte in cells(t):
            for k in range(order + 1):
                follow[context[order - k :]][byte] += 1
    out = []
    for t in texts:
        total = 0.0
        for context, byte in cells(t):
            excluded = set()
            for k in range(order, -1, -1):
                live = {b: n for b, n in follow[context[order - k :]].items() if b not in excluded and (k < 2 or n >= least)}
                size = sum(live.values()) + len(live)
                if byte in live:
                    total += math.log2(size / live[byte])
                    break
                if live:
                    total += math.log2(size / len(live))
                excluded |= set(live)
            else:
                total += math.log2(256 - len(excluded))
        out.append(total)
    return out


def ppm_texts(order):
    rng = random.Random(order)
    texts = ["".join(rng.choice("abcd é\0") for _ in range(rng.randrange(0, 80))) for _ in range(30)]
    return [*texts, "", "a", "abababababab", "the cat sat on the mat", "the cat sat on the mat", "ÿ", None, "z" * 300]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("nodes", [lm_scoring.NODES, 40])
def test_code_lengths_are_those_of_brute_force(spark, order, nodes):
    texts = ppm_texts(order)
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(None, "abc", ""), (3, texts[3], "")]
    df = table(spark, rows)
    found = lm_scoring.score_documents(df, order, nodes=nodes)
    assert found.columns == ["doc_id", "n_bytes", "code_length", "bits_per_byte"]
    half = [r[0] for r in spark.createDataFrame([(t,) for _, t, _ in rows], "t string").select(F.coalesce(F.pmod(F.xxhash64("t"), F.lit(2)), F.lit(0))).collect()]
    assert set(half) == {0, 1}
    expected = []
    for p in (0, 1):
        fitted = [t for (_, t, _), h in zip(rows, half, strict=True) if h != p]
        seen = Counter(x[k : k + d + 1] for t in fitted for x in [bytes(order) + (t or "").encode()] for d in range(2, order + 1) for k in range(order - d, len(x) - d))
        least = next(n for n in range(1, 10**6) if sum(m >= n for m in seen.values()) <= nodes)
        assert (least > 1) is (nodes == 40)
        own = [(i, t) for (i, t, _), h in zip(rows, half, strict=True) if h == p]
        for (i, t), b in zip(own, brute_bits(fitted, [t for _, t in own], order, least), strict=True):
            n = None if t is None else len(t.encode())
            expected.append((i, n, None if n is None else b, None if n is None else (b / n if n else 0.0)))
    by = lambda r: (repr(r[0]), repr(r[1]))
    for a, b in zip(sorted((tuple(r) for r in found.collect()), key=by), sorted(expected, key=by), strict=True):
        assert a[:2] == b[:2]
        assert (a[2] is None) == (b[2] is None)
        if b[2] is not None:
            assert a[2] == pytest.approx(b[2], abs=2e-3) and a[3] == pytest.approx(b[3], abs=1e-3)


@pytest.mark.parametrize("sent", [0, 25])
def test_models_keep_every_node_whatever_is_sent(spark, sent, monkeypatch):
    """Codes that are not sent to every task are looked up by a shuffle: scores are those of the whole model."""
    monkeypatch.setattr(lm_scoring, "_PLACES", 50)
    texts = [*ppm_texts(4), "only here: q7#"]
    df = table(spark, [(i, t, "") for i, t in enumerate(texts)] + [(None, "abc", ""), (3, texts[3], "")])
    assert lm_scoring.NODES == math.inf, "no bound on what a model has"
    rows = lambda x: sorted((tuple(r) for r in x.collect()), key=repr)
    whole, found = rows(lm_scoring.score_documents(df)), rows(lm_scoring.score_documents(df, sent=sent))
    assert len(found) == len(texts) + 2
    for a, b in zip(found, whole, strict=True):
        assert a[:2] == b[:2] and (a[2:] == b[2:] == (None, None) or a[2:] == pytest.approx(b[2:], abs=2e-3))
    model = lm_scoring.fit(df.limit(0).unionByName(table(spark, [(1, t, "") for t in texts])))
    others = ["the mat sat on the cat", "", None, "nothing of it: QXJ"]
    found = {r.doc_id: r.code_length for r in lm_scoring.score(table(spark, [(i, t, "") for i, t in enumerate(others)]), model, sent=sent).collect()}
    for i, (t, b) in enumerate(zip(others, brute_bits(texts, others, 4), strict=True)):
        assert found[i] is None if t is None else found[i] == pytest.approx(b, abs=2e-3)


def test_a_model_of_one_table_scores_another(spark):
    texts = ppm_texts(4)
    others = ["the mat sat on the cat", "", None, "nothing of it: QXJ", "abab" * 50]
    model = lm_scoring.fit(table(spark, [(1, t, "") for t in texts]))
    found = {r.doc_id: r.code_length for r in lm_scoring.score(table(spark, [(i, t, "") for i, t in enumerate(others)]), model).collect()}
    for i, (t, b) in enumerate(zip(others, brute_bits(texts, others, 4), strict=True)):
        assert found[i] is None if t is None else found[i] == pytest.approx(b, abs=2e-3)
    nothing = lm_scoring.fit(table(spark, []))
    assert [r.code_length for r in lm_scoring.score(table(spark, [(1, "abc", "")]), nothing).collect()] == [24.0]


def test_scoring_nothing(spark):
    assert lm_scoring.score_documents(table(spark, [])).count() == 0
    assert [tuple(r) for r in lm_scoring.score_documents(table(spark, [(1, None, ""), (2, "", "")])).orderBy("doc_id").collect()] == [(1, None, None, None), (2, 0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        lm_scoring.score_documents(table(spark, []), 5)


def test_odd_texts_cost_more(spark):
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["this", "that", "other", "word", "again"]) for _ in range(80)) for _ in range(30)]
    odd = "".join(rng.choice("qwzx#@!7") for _ in range(400))
    scores = {r.doc_id: r.bits_per_byte for r in lm_scoring.score_documents(table(spark, [(i, t, "") for i, t in enumerate([*plain, odd])])).collect()}
    assert scores[30] > 2 * max(scores[i] for i in range(30))


# language ---


def test_codewords_lie_far_apart():
    for n in (2, 4, 6, 9, 20):
        code = language.codewords(n)
        gaps = [(code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2)]
        assert min(gaps) >= (2 ** (n - 2) if n <= 6 else code.shape[1] // 4)
    assert language.codewords(0).shape[0] == 0 and language.codewords(1).shape == (1, 1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40")
    model = language.train(docs.where("doc_id % 2 = 0"))
    found = language.identify_languages(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang").distinct(), "doc_id")
    right, n = found.agg(F.sum((F.col("language") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert right / n >= 0.97


def test_decoding_takes_the_nearest_codeword():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((language.FEATURES, 7), np.float32), np.zeros(7), np.full(7, 1 / 7, np.float32))
    votes = code * 3.0
    votes[:, 0] *= -1  # one bit wrong
    best, lead, doubt = language.decode(model, votes, np.ones(4), 0.05)
    assert best.tolist() == [0, 1, 2, 3] and not doubt.any() and (lead > 0.05).all()
    best, lead, doubt = language.decode(model, np.zeros((2, 7)), np.array([1, 0]), 0.05)
    assert best.tolist() == [0, -1] and doubt.all() and lead.tolist() == [0, 0]


def test_language_of_odd_rows(spark):
    good = [(i, f"the quick thing number {i} was there and then", "en") for i in range(20)] + [(100 + i, f"der schnelle Hund Nummer {i} war dort und dann", "de") for i in range(20)]
    odd = [(200, None, "en"), (201, "", "de"), (202, "123 !!", "en"), (203, "the thing was there " * 20_000, None), (None, "und dann war der Hund", "de"), (0, good[0][1], "en")]
    df = table(spark, good + odd)
    model = language.train(df)
    found = language.identify_languages(df, model)
    assert found.count() == len(good + odd)
    got = {r.doc_id: (r.language, r.ambiguous) for r in found.collect()}
    assert got[200] == got[201] == got[202] == (None, True)
    assert got[203] == ("en", False) and got[None] == ("de", False) and got[5] == ("en", False) and got[105] == ("de", False)
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == len(good + odd) - 3
    none = language.train(df.where("lang IS NULL"))
    assert none is None and language.keep_identified(df, none).count() == 0
    assert {r.ambiguous for r in language.identify_languages(df, none).collect()} == {True}
    assert language.identify_languages(table(spark, []), model).count() == 0
    one = language.train(df.where("lang = 'en'"))
    assert {r.language for r in language.identify_languages(df.where("doc_id < 20"), one).collect()} == {"en"}


def brute_buckets(text):
    """Every letter of a text with its neighbours, byte by byte; anything else is one space."""
    folded = "".join(ch.lower() if ch.isascii() or "À" <= ch <= "Þ" else ch for ch in text or "").encode()
    plain = [32]
    for b in folded:
        if 97 <= b <= 122 or b >= 128:
            plain.append(b)
        elif plain[-1] != 32:
            plain.append(32)
    plain.append(32)
    return [(((plain[k - 1] | plain[k] << 8 | plain[k + 1] << 16) * 0x9E3779B1) % 2**32) >> 19 for k in range(1, len(plain) - 1) if plain[k] != 32]


def test_features_votes_and_verdicts_are_those_of_brute_force():
    rng = random.Random(3)
    texts = ["", None, "A.", "é", "Ünd ÑO 12 x", "one  two\n\nthree-four", "日本 語", "x" * 3000, *("".join(rng.choice("abcXYZéÑß .,12\n") for _ in range(rng.randrange(80))) for _ in range(60))]
    model = language.Model(list("abcd"), language.codewords(4), np.random.default_rng(1).normal(size=(language.FEATURES, 7)).astype(np.float32), np.arange(7) / 7, np.full(7, 1 / 7, np.float32))
    x = language.features([t or "" for t in texts])
    for most in (50, 1 << 20):
        at = 0
        for c in chunks(pa.array(texts, pa.string()), most):
            votes, seen = language.score(model, c)
            best, lead, doubt = language.decode(model, votes, seen, 0.05)
            for k in range(c.rows):
                own = brute_buckets(texts[at])
                assert seen[k] == len(own) and {b: round(float(v) * len(own)) for b, v in enumerate(x[at]) if v} == Counter(own)
                vote = [sum(float(model.weight[b, bit]) for b in own) / max(1, len(own)) + bit / 7 for bit in range(7)]
                assert np.allclose(votes[k], vote)
                loss = [sum(math.log1p(math.exp(-v * w)) / 7 for v, w in zip(vote, word, strict=True)) for word in model.code.tolist()]
                order = sorted(range(4), key=lambda i: loss[i])
                assert best[k] == (order[0] if own else -1) and doubt[k] == (not own or lead[k] < 0.05)
                assert math.isclose(lead[k], loss[order[1]] - loss[order[0]] if own else 0.0, abs_tol=1e-6)
                at += 1
        assert at == len(texts)


def test_the_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    rows = [(None, f"text number {k} of many", "en") for k in range(300)] + [(7, "the very same", "de")] * 300 + [(8, "z" * 70_000, "fr")]
    texts, labels = language.labelled_sample(table(spark, rows), 20, "doc_id", "text", "lang")
    assert Counter(labels).get("fr") is None and Counter(labels)["de"] == 1 and 5 <= Counter(labels)["en"] <= 20 and len(set(texts)) == len(texts)
    monkeypatch.setattr(language, "SAMPLE_ROWS", 6)
    assert max(Counter(language.labelled_sample(table(spark, rows), 20, "doc_id", "text", "lang")[1]).values()) <= 3


def test_rows_are_framed_by_spaces():
    def trigrams(text):
        framed = " " + re.sub("[^a-z]+", " ", text.lower()) + " "
        return [(sum(ord(x) << 8 * k for k, x in enumerate(framed[i - 1 : i + 2])) * 0x9E3779B1 % 2**32) >> 19 for i in range(1, len(framed) - 1) if framed[i] != " "]

    texts = ["a", "Ab", "", "A.", "12", " an 1 apple", "--x", None, "b c"]
    c = next(chunks(pa.array(texts)))
    bucket, counts = language.trigram_buckets(c)
    assert counts.tolist() == [len(trigrams(t or "")) for t in texts] == [1, 2, 0, 1, 0, 7, 1, 0, 2]
    assert bucket.tolist() == [x for t in texts for x in trigrams(t or "")]


def test_what_is_ambiguous_is_not_kept(spark):
    """A model that leans to no language leaves nothing by default, and all texts with a letter without a margin."""
    even = language.Model(["de", "en"], language.codewords(2), np.zeros((language.FEATURES, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    df = table(spark, [(1, "some words", "en"), (2, "A.", "en"), (3, "12", "en")])
    assert {r.ambiguous for r in language.identify_languages(df, even).collect()} == {True}
    assert language.keep_identified(df, even).count() == 0
    assert sorted(r.doc_id for r in language.keep_identified(df, even, margin=0.0).collect()) == [1, 2]


# sampled segmentations ---


@pytest.fixture(scope="module")
def lattices():
    return sentencepiece_sampling.Lattices(sentencepiece_sampling.Vocabulary.load())


def all_paths(text, lattices):
    """Every segmentation within units of a text, with its normalised log-probability."""
    v = lattices.vocabulary
    data = b" " + text.encode()
    ids = {p: i for i, p in enumerate(v.pieces) if p}
    cuts = [0] + [k for k in range(1, len(data)) if not lattices.joined[data[k - 1] << 8 | data[k]] and data[k] & 0xC0 != 0x80] + [len(data)]
    units = []
    for a, b in itertools.pairwise(cuts):

        def ways(at, b=b):
            if at == b:
                return [((), 0.0)]
            out, char = [], next(k for k in range(at + 1, b + 1) if k == b or data[k] & 0xC0 != 0x80)
            for end in range(at + 1, b + 1):
                if data[at:end] in ids:
                    out += [((ids[data[at:end]], *rest), v.weight[ids[data[at:end]]] + w) for rest, w in ways(end)]
            if data[at:char] not in ids:
                out += [((*[int(v.byte_ids[x]) for x in data[at:char]], *rest), lattices.byte_weight * (char - at) + w) for rest, w in ways(char)]
            return out

        found = ways(a)
        total = math.log(math.fsum(math.exp(w) for _, w in found))
        units.append([(p, w - total) for p, w in found])
    out = {}
    for parts in itertools.product(*units):
        out[tuple(i for p, _ in parts for i in p)] = sum(w for _, w in parts)
    return out


def drawn(texts, lattices, k, seeds):
    c = next(chunks(pa.array(texts)))
    s = sentencepiece_sampling.sample(sentencepiece_sampling.Batch(c, sentencepiece_sampling.Store(lattices)), c.rows, mix64(np.asarray(seeds, dtype=np.uint64)), k)
    ends = np.cumsum(s.count)
    return [(int(r), int(n), tuple(s.ids[e - m : e].tolist()), lp, key, inc) for r, n, e, m, lp, key, inc in zip(s.row, s.rank, ends, s.count, s.log_p, s.key, s.inclusion, strict=True)]


@pytest.mark.parametrize("text", ["the", "a b", "so it", "né", "𝒳", "12"])
def test_samples_are_paths_with_their_probability(lattices, text):
    paths = all_paths(text, lattices)
    assert math.fsum(map(math.exp, paths.values())) == pytest.approx(1)
    k = 4
    rows = defaultdict(list)
    for r, rank, ids, lp, key, _ in drawn([text] * 50, lattices, k, range(50)):
        assert lp == pytest.approx(paths[ids], abs=1e-6)
        rows[r].append((rank, ids, key))
    for found in rows.values():
        assert len({ids for _, ids, _ in found}) == len(found) >= min(k, sum(w > -20 for w in paths.values()))
        keys = [key for _, _, key in sorted(found)]
        assert keys == sorted(keys, reverse=True)


def test_what_is_drawn_does_not_depend_on_the_store_or_the_batch(lattices, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abeinortxé12") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    seeds = mix64(np.arange(len(texts), dtype=np.uint64))

    def rows(most, store):
        out = []
        for c in chunks(pa.array(texts), most):
            b = sentencepiece_sampling.Batch(c, store)
            s = sentencepiece_sampling.sample(b, c.rows, seeds[c.lo : c.hi], 3)
            data, at = sentencepiece_sampling.decode_rows(s.ids, s.count, lattices)
            ends = np.cumsum(s.count)
            for k, (r, rank, e, m, lp) in enumerate(zip(s.row, s.rank, ends, s.count, s.log_p, strict=True)):
                assert data[at[k] : at[k + 1]].tobytes().decode() == " " + texts[c.lo + r]
                out.append((c.lo + int(r), int(rank), tuple(s.ids[e - m : e].tolist()), round(float(lp), 6)))
        return sorted(out)

    whole = rows(1 << 20, sentencepiece_sampling.Store(lattices))
    monkeypatch.setattr(sentencepiece_sampling.Store, "BOUND", 900)
    small = sentencepiece_sampling.Store(lattices)
    assert rows(600, small) == whole and rows(1500, small) == whole


def test_two_long_words_of_one_hash_modulo_a_power_of_two_keep_apart(lattices):
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    texts = ["".join("ab"[b ^ k] for b in bits) for k in (0, 1)]
    store = sentencepiece_sampling.Store(lattices)
    for t in texts:
        c = next(chunks(pa.array([t])))
        s = sentencepiece_sampling.sample(sentencepiece_sampling.Batch(c, store), 1, np.ones(1, np.uint64), 2)
        data, at = sentencepiece_sampling.decode_rows(s.ids, s.count, lattices)
        assert [data[a:z].tobytes().decode() for a, z in zip(at, at[1:], strict=False)] == [" " + t] * 2


def test_first_and_second_samples_follow_their_distribution(lattices):
    text, n = "the", 4000
    paths = all_paths(text, lattices)
    p = {x: math.exp(w) for x, w in paths.items()}
    first, second = Counter(), Counter()
    by_row = defaultdict(dict)
    for r, rank, ids, *_ in drawn([text] * n, lattices, 2, range(n)):
        by_row[r][rank] = ids
    for found in by_row.values():
        first[found[1]] += 1
        second[found[2]] += 1
    other = {x: sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x) for x in p}
    for x in p:
        for seen, expected in ((first[x], p[x]), (second[x], other[x])):
            assert abs(seen / n - expected) < 5 * math.sqrt(expected * (1 - expected) / n) + 2e-3


def test_inclusion_scores_weigh_estimates(lattices):
    text, n = "so it", 3000
    paths = all_paths(text, lattices)
    truth = sum(math.exp(w) * len(x) for x, w in paths.items())
    total = defaultdict(float)
    for r, _, ids, lp, _, inclusion in drawn([text] * n, lattices, 3, range(n)):
        total[r] += math.exp(lp) / inclusion * len(ids)
    assert sum(total.values()) / n == pytest.approx(truth, rel=0.05)


def test_every_text_decodes_and_odd_rows_have_their_result(spark):
    rng = random.Random(4)
    texts = ["", None, " ", "  two  spaces ", "line\nbreak\ttab", "né 𝒳 ß 漢字", "a▁b", "word " * 20_000, "".join(rng.choice("abé\n 1") for _ in range(500))]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(8, texts[8], ""), (None, "null id", ""), (None, "null id", "")]
    df = table(spark, rows)
    found = sentencepiece_sampling.sampled_segmentations(df, samples=3)
    got = defaultdict(list)
    for r in found.collect():
        got[r.doc_id].append(r)
    assert [(x.ids, x.log_prob, x.inclusion, x.decodes) for x in got[0]] == [([], 0.0, 1.0, True)]
    assert [(x.ids, x.decodes) for x in got[1]] == [(None, None)]
    assert all(x.decodes is (i != 6) for i, found in got.items() for x in found if i != 1)
    assert len(got[8]) == 6 and len({tuple(x.ids) for x in got[8]}) == 3  # a repeated row gives equal rows
    assert len(got[7]) == 3 and len({tuple(x.ids) for x in got[7]}) == 3
    assert len({(x.rank, tuple(x.ids)) for x in got[None]}) == 3 and len(got[None]) == 6
    back = found.where("ids IS NOT NULL").select("doc_id", sentencepiece_sampling.decoder()("ids").alias("t")).collect()
    for r in back:
        expected = (texts[r.doc_id] if r.doc_id is not None else "null id").replace("▁", " ")
        assert r.t == expected
    assert sentencepiece_sampling.sampled_segmentations(table(spark, [])).count() == 0
    assert sorted(map(repr, found.collect())) == sorted(map(repr, sentencepiece_sampling.sampled_segmentations(df.repartition(3), samples=3).collect()))


def test_encoder_is_the_models_own(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sampling.MODEL)
    texts = ["plain words here", "", None, "né 漢"]
    df = table(spark, [(i, t, "") for i, t in enumerate(texts)]).withColumn("e", sentencepiece_sampling.encoder()("text"))
    rows = df.withColumn("d", sentencepiece_sampling.decoder()("e")).orderBy("doc_id").collect()
    assert [r.e for r in rows] == [None if t is None else model.encode(t) for t in texts]
    assert [r.d for r in rows] == texts


def test_costs_are_json_safe(spark):
    row = lm_scoring.score_documents(table(spark, [(1, "abc", "")])).first()
    assert json.dumps(row.asDict())


def test_texts_that_pass_make_a_worker_release_memory(monkeypatch):
    released = []
    monkeypatch.setattr(kernels, "release", lambda: released.append(1))
    monkeypatch.setattr(kernels, "_passed", 0)
    for _ in range(3):
        for _ in kernels.chunks(pa.array(["x" * 1000] * 10_000)):
            pass
    assert len(released) == 3 * 10_000_000 // kernels._RELEASED
    kernels.release()
