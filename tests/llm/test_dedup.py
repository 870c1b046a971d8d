from __future__ import annotations

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, simhash, substring_dedup
from quillspark.llm.kernels import chunks

SCHEMA = "doc_id long, text string, id long, _id string, text_hash int, group_id string, _row int, _fp string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, "z") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


# exact ---

ODD = [(5, "same"), (3, "same"), (3, "same"), (9, None), (8, None), (7, ""), (6, ""), (None, "same"), (None, "alone"), (None, None), (4, "long " * 50_000), (2, "long " * 50_000), (1, "Same")]


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


@pytest.mark.parametrize("collide", [False, True])
def test_exact_duplicates(spark, collide):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t].append(i)
    expected = []
    for i, t in ODD:
        keep = i if t is None else least(groups[t])
        copies = 1 if t is None else len(groups[t])
        expected.append((i, keep, copies, i != keep))
    kw = {"fingerprint": lambda c: (F.length(c) % 3).cast("long")} if collide else {}
    df = table(spark, ODD)
    found = [tuple(r) for r in exact_dedup.exact_duplicates(df, **kw).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    left = exact_dedup.drop_exact_duplicates(df, **kw)
    assert left.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    want = [(i, t) for t, ids in groups.items() for i in (ids if t is None else [least(ids)])]
    assert kept == sorted(want, key=repr)


def test_exact_of_nothing(spark):
    df = table(spark, [])
    assert exact_dedup.exact_duplicates(df).count() == 0 and exact_dedup.drop_exact_duplicates(df).columns == df.columns


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    for top_bits in (1, 4):
        parts = []
        for _ in range(3):
            keys = rng.integers(0, 2**63, 500, dtype=np.uint64) >> np.uint64(top_bits)
            keys[:100] = np.arange(100, dtype=np.uint64) * np.uint64(2**40)
            parts.append(np.unique(keys, return_counts=True))
        parts.append((np.array([2**60 - 1], dtype=np.uint64), np.array([7])))
        filters = [exact_dedup.cqf_build(k, c, top_bits) for k, c in parts]
        total = defaultdict(int)
        for k, c in parts:
            for x, n in zip(k.tolist(), c.tolist(), strict=True):
                total[x] += n
        for (k, c), f in zip(parts, filters, strict=True):
            got = exact_dedup.cqf_read(f, 0, top_bits)
            assert got[0].tolist() == k.tolist() and got[1].tolist() == c.tolist()
        keys, counts = exact_dedup.cqf_read(exact_dedup.cqf_merge(filters, 0, top_bits), 0, top_bits)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == dict(total)


# near ---


def brute_groups(rows, radius):
    """Groups by comparing all fingerprints with all."""
    known = [(i, t) for i, t in rows if i is not None and t]
    prints = []
    for c in chunks(pa.array([t for _, t in known], pa.string())):
        high, low, has = simhash.fingerprints(c)
        prints += [(int(h) << 64 | int(x)) if k else None for h, x, k in zip(high, low, has, strict=True)]
    parent = list(range(len(known)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            near = prints[a] is not None and prints[b] is not None and (prints[a] ^ prints[b]).bit_count() <= radius
            if (near or (known[a][0] == known[b][0] and prints[a] is not None and prints[b] is not None)) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    members = defaultdict(list)
    for k in range(len(known)):
        if prints[k] is not None:
            members[root(k)].append(k)
    out = []
    at = 0
    for i, t in rows:
        if i is None or not t or prints[at] is None:
            out.append((i, i, 1, False))
        else:
            group = members[root(at)]
            first = min(known[k][0] for k in group)
            out.append((i, first, len(group), i != first))
        at += i is not None and bool(t)
    return out


def near_copies(rng):
    rows, n = [], 0
    for _ in range(25):
        base = prose(rng, 150).split()
        for _ in range(rng.randrange(1, 6)):
            words = base.copy()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "edges"), [(simhash.BLOCK, simhash.EDGES), (8, 0)])
def test_near_duplicates_are_those_of_brute_force(spark, block, edges):
    rows = near_copies(random.Random(3))
    rows += [(500, None), (501, ""), (502, " -- "), (None, rows[0][1]), rows[1], rows[1], (503, "wort " * 30_000), (504, "wort " * 30_001)]
    expected = brute_groups(rows, simhash.RADIUS)
    df = table(spark, rows)
    found = [tuple(r) for r in simhash.near_duplicates(df, block=block, edges=edges).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(e[3] for e in expected) > 20
    if edges:
        left = simhash.drop_near_duplicates(df)
        assert left.columns == df.columns
        kept = sorted((r.doc_id for r in left.collect()), key=repr)
        want = [i for i, g, _, _ in expected if i is None or i == g]
        repeats = [i for i, t in set(rows) if rows.count((i, t)) > 1 for _ in range(rows.count((i, t)) - 1) if (i, i) in {(e[0], e[1]) for e in expected}]
        for i in repeats:
            want.remove(i)
        assert kept == sorted(want, key=repr)


def test_fingerprints_are_the_same_in_any_chunk():
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(500)]

    def prints(some, most):
        return [cell for c in chunks(pa.array(some, pa.string()), most) for cell in zip(*(x.tolist() for x in simhash.fingerprints(c)), strict=True)]

    assert prints(texts, 1 << 20) == prints(texts, 700) == [prints([t], 1 << 20)[0] for t in texts]


@pytest.mark.parametrize(("radius", "flips"), [(23, 14), (7, 3), (3, 1), (0, 0)])
def test_trees_find_every_pair_within_the_radius(radius, flips):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, (200, 2), dtype=np.uint64)
    x = base[rng.integers(0, 200, 1500)]
    for _ in range(flips):
        x = x ^ ((rng.random(x.shape) < 0.6).astype(np.uint64) << rng.integers(0, 64, x.shape).astype(np.uint64))
    x = np.unique(x, axis=0)
    apart = np.bitwise_count(x[:, None] ^ x[None]).astype(int).sum(axis=2)
    expected = {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= radius), strict=True) if a < b}
    found, crossed = set(), set()
    for lead, code in simhash._led(x[:, 0], x[:, 1], radius):
        for c in np.unique(code):
            rows = np.flatnonzero(code == c)
            steps = simhash.levels(radius, lead, len(rows))
            at = int(simhash.cuts(radius)[lead])
            whole, left, right = (simhash.GrayIndex(*simhash.turned(x[k, 0], x[k, 1], at), [b for b, _ in steps]) for k in (rows, rows[::2], rows[1::2]))
            found |= {(min(p), max(p)) for a, b in simhash.close_pairs(whole, whole, radius, lead, steps) for p in zip(rows[a].tolist(), rows[b].tolist(), strict=True)}
            crossed |= {(min(p), max(p)) for a, b in simhash.close_pairs(left, right, radius, lead, steps) for p in zip(rows[::2][a].tolist(), rows[1::2][b].tolist(), strict=True)}
    assert found == expected and crossed <= expected and (not radius or expected)


def test_each_fingerprint_goes_to_one_block_a_segment(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(h), int(m)) for i, (h, m) in enumerate(rng.integers(-(2**63), 2**63, (300, 2)))]
    rows += [(1000 + i, h ^ 5, m) for i, h, m in rows[:40]]
    fps = spark.createDataFrame(rows, "id long, high long, low long")
    for block in (simhash.BLOCK, 3):
        tiles = simhash._tiles(fps, simhash.RADIUS, block)
        assert bool(tiles.max() == 1) is (block > 3)
        assert {(min(r), max(r)) for r in simhash.close_edges(fps, block=block).collect()} == {(i, 1000 + i) for i in range(40)}


def test_many_near_fingerprints_are_compared_piece_by_piece(monkeypatch):
    monkeypatch.setattr(simhash, "_PAIRS", 1000)
    low = np.arange(400, dtype=np.uint64)
    steps = simhash.levels(simhash.RADIUS, 0, len(low))
    index = simhash.GrayIndex(np.zeros(400, np.uint64), low, [bits for bits, _ in steps])
    found = [len(a) for a, _ in simhash.close_pairs(index, index, simhash.RADIUS, 0, steps)]
    assert sum(found) == 400 * 399 // 2 and max(found) <= 1000


def test_edges_of_a_group_are_not_held_at_once():
    rng = np.random.default_rng(2)

    def batches():
        for _ in range(100):
            a = rng.integers(0, 500, 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(7 * a), pa.array(7 * (a + 1))], names=["a", "b"])

    tracemalloc.start()
    ids, a, b = simhash._gathered(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == [7 * k for k in range(501)] and len(a) == 500 and set(simhash.roots(501, a, b).tolist()) == {0}
    assert peak < 160e6, "all edges alone are 160 MB"


def test_a_task_gathers_no_more_edges_than_it_has_memory_for():
    """An executor has about 3 GB, of which its JVM takes most: a forest of EDGES edges that share no end must fit beside it."""

    def batches():
        for lo in range(0, simhash.EDGES, 1 << 16):
            a = 2 * np.arange(lo, min(lo + (1 << 16), simhash.EDGES))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(a + 1)], names=["a", "b"])

    tracemalloc.start()
    ids, a, _ = simhash._gathered(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == simhash.EDGES and len(ids) == 2 * len(a)
    assert peak < 250e6


def test_pairs_that_labels_leave_apart_are_given_piece_by_piece(spark, monkeypatch):
    """All pairs of a cluster, which grow with its square, leave a task as they are found."""
    sizes = []
    real = simhash._batches
    monkeypatch.setattr(simhash, "_batches", lambda names, *x: sizes.append(len(x[0])) or real(names, *x))
    joins = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, deal, _):
            self.deal = deal
            return self

        def groupBy(self, _):
            return self

        def applyInArrow(self, join, _):
            joins.append((self.deal, join))

    n = 1500
    monkeypatch.setattr(simhash, "_tiles", lambda *_: np.ones((simhash.RADIUS + 1, 256), dtype=np.int64))
    simhash.close_edges(Rows(), every=True)
    deal, join = joins[0]
    ids = pa.array(np.arange(n))
    dealt = pa.Table.from_batches(deal([pa.RecordBatch.from_arrays([ids, pa.array(np.zeros(n, np.int64)), ids, ids], names=["id", "high", "low", "label"])]))
    task = dealt.column("task")[0]
    own = dealt.filter(pa.array([x == task for x in dealt.column("task")]))
    found = sum(b.num_rows for b in join((task,), iter(own.select(["side", "packed"]).to_batches())))
    assert found == n * (n - 1) // 2 and max(sizes) <= simhash._PAIRS


def test_near_of_nothing(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(table(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(table(spark, [(1, None), (2, "")])).count() == 2


def test_copies_are_caught_and_others_left(spark):
    rng = random.Random(8)
    rows, copies, others = [], set(), set()
    for k in range(60):
        words = prose(rng, 200).split()
        rows.append((2 * k, " ".join(words)))
        if k % 2:
            words[rng.randrange(200)] = "changed"
            rows.append((2 * k + 1, " ".join(words)))
            copies.add(2 * k + 1)
        else:
            rows.append((2 * k + 1, prose(rng, 200)))
            others.add(2 * k + 1)
    gone = {r.doc_id for r in simhash.near_duplicates(table(spark, rows)).where("is_duplicate").collect()}
    assert gone & others == set() and len(gone & copies) >= 0.9 * len(copies)


def test_near_fingerprints_of_other_texts_are_no_link(spark):
    """One bag of words in two orders has one fingerprint; copies of each join, the two don't."""
    rng = random.Random(4)
    words = prose(rng, 300).split()
    other = words.copy()
    rng.shuffle(other)
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join([*words[:-1], "changed"])), (4, " ".join([*other[:-1], "changed"])), (5, " ".join(words).upper()), (6, " ".join(other) + "!")]
    found = {r.doc_id: (r.group_id, r.members) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert found == {1: (1, 3), 3: (1, 3), 5: (1, 3), 2: (2, 3), 4: (2, 3), 6: (2, 3)}
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(table(spark, rows)).collect()) == [1, 2]
    found = {r.doc_id: r.group_id for r in simhash.near_duplicates(table(spark, rows), block=2, edges=0).collect()}
    assert found == {1: 1, 3: 1, 5: 1, 2: 2, 4: 2, 6: 2}


# passages ---


def brute_spans(rows, least):
    """Every stretch of `least` words looked up among all."""
    places = defaultdict(list)
    split = []
    for k, (i, text) in enumerate(rows):
        words, at = [], 0
        for w in (text or "").split() if i is not None else []:
            start = text.index(w, at)
            at = start + len(w)
            words.append((start, at))
        split.append(words)
        for j in range(len(words) - least + 1):
            places[text[words[j][0] : words[j + least - 1][1]]].append((k, j))
    out = []
    for k, (i, text) in enumerate(rows):
        words = split[k]
        span = None
        for j in range(len(words) - least + 1):
            stretch = text[words[j][0] : words[j + least - 1][1]]
            if len(places[stretch]) < 2:
                continue
            if span and j <= span[1]:
                span[1] = j + least
            else:
                span = [j, j + least, min(rows[p[0]][0] for p in places[stretch])]
                out.append((k, i, span))
    return sorted({(i, split[k][s[0]][0], split[k][s[1] - 1][1], s[1] - s[0], s[2]) for k, i, s in out})


@pytest.mark.parametrize(("broadcast", "heavy"), [(True, 1e-5), (False, 1e-5), (True, 0.002), (True, 0.02), (False, 0.02), (True, 2.0)])
def test_repeated_passages_are_those_of_brute_force(spark, broadcast, heavy, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rng = random.Random(6)
    shared = [prose(rng, n) for n in (6, 7, 11, 20, 40)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 20)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        parts.insert(rng.randrange(4), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(50, None), (51, ""), (52, "é " * 30), (53, "few words"), (54, "a b c d e a b c d e a b c d e"), (None, rows[0][1])]
    found = substring_dedup.repeated_spans(table(spark, rows), block=3, least=6, most_anchors=substring_dedup.ANCHORS if broadcast else -1)
    assert sorted(tuple(r) for r in found.collect()) == brute_spans(rows, 6)


def test_many_anchors_need_no_shuffle_of_all_windows(spark, monkeypatch):
    rng = random.Random(6)
    shared = [prose(rng, 12) for _ in range(4)]
    rows = [(i, f"{prose(rng, 9)} {rng.choice(shared)} {prose(rng, 9)} {rng.choice(shared)}") for i in range(20)]
    expected = brute_spans(rows, 6)
    joined = substring_dedup.repeated_spans(table(spark, rows), block=3, least=6, most_anchors=-1, most_filtered=-1)
    assert sorted(tuple(r) for r in joined.collect()) == expected
    monkeypatch.setattr(substring_dedup, "_places", None)
    found = substring_dedup.repeated_spans(table(spark, rows), block=3, least=6, most_anchors=-1)
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_a_filter_holds_every_anchor_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup.Filter, "PART", 11)
    keys = np.random.default_rng(3).integers(0, 1 << 48, 250_000)
    hot = spark.createDataFrame(pa.table({"anchor": keys[:50_000]}))
    sieve = substring_dedup.Filter.of(hot, 50_000)
    held = sieve.holds(keys.astype(np.uint64))
    assert held[:50_000].all() and held[50_000:].mean() < 1e-3 and len(sieve.words) * 8 <= 4 * 50_000


def test_repeated_rows_share_their_passages(spark):
    text = prose(random.Random(1), 70)
    found = substring_dedup.repeated_spans(table(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted(set(tuple(r) for r in found)) == [(1, 0, len(text), 70, 1), (2, 0, len(text), 70, 1)]
    assert substring_dedup.repeated_spans(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(table(spark, []), block=30, least=50)


def test_each_shared_passage_has_its_own_origin(spark):
    rng = random.Random(9)
    p, q, a, b = (prose(rng, n) for n in (30, 25, 40, 40))
    whole = f"{a} {p} {b}"
    rows = [(1, p), (2, q), (10, whole), (20, whole), (30, f"{prose(rng, 9)} {p} {q} {prose(rng, 9)}")]
    for anchors in (substring_dedup.ANCHORS, -1):
        found = substring_dedup.repeated_spans(table(spark, rows), block=3, least=6, most_anchors=anchors, merged=False).collect()
        texts = dict(rows)
        spans = {(r.doc_id, r.words, r.first_id, texts[r.doc_id][r.start_char : r.end_char]) for r in found}
        assert {(i, 30, 1, p) for i in (1, 10, 20, 30)} | {(2, 25, 2, q), (30, 25, 2, q)} <= spans
        assert {(i, k, 10) for i in (10, 20) for k in (45,)} == {(i, k, f) for i, k, f, _ in spans if i in (10, 20) and f == 10} and len(found) == 10


@pytest.mark.parametrize("heavy", [1e-5, 0.01, 0.05, 2.0])
def test_spans_are_the_same_whatever_is_heavy(spark, heavy, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rng = random.Random(12)
    shared = [prose(rng, n) for n in (7, 9, 30)]
    rows = [(i, " ".join([prose(rng, rng.randrange(9)), *rng.choices(shared, (1, 9, 3), k=2), prose(rng, rng.randrange(9))])) for i in range(60)]
    rows += [rows[3], rows[3], (61, rows[3][1]), (None, shared[0])]
    df = table(spark, rows).repartition(3)
    found = sorted(tuple(r) for r in substring_dedup.repeated_spans(df, block=3, least=6, merged=False).collect())
    # spans end where the rows that share a stretch, or the first of them, change
    known = [(i, t) for i, t in rows if i is not None]
    places = defaultdict(list)
    for k, (_, t) in enumerate(known):
        w = t.split()
        for j in range(len(w) - 5):
            places[" ".join(w[j : j + 6])].append((k, j))
    expected = set()
    for k, (i, t) in enumerate(known):
        w = t.split()
        starts = [sum(len(x) + 1 for x in w[:j]) + (len(t) - len(t.lstrip())) for j in range(len(w))]
        assert all(t[a : a + len(x)] == x for a, x in zip(starts, w, strict=True)) or "  " in t
        span = None
        for j in range(len(w) - 5):
            at = places[" ".join(w[j : j + 6])]
            if len(at) < 2:
                span = None
                continue
            of = (min(known[p][0] for p, _ in at), frozenset(p for p, _ in at))
            if span and span[2] == of:
                span[1] = j + 6
            else:
                span = [j, j + 6, of]
                expected.add((i, k, id(span)))
                places.setdefault(("spans", k), []).append(span)
    count = sum(len(places.get(("spans", k), [])) for k in range(len(known)) if (known[k] not in known[:k]))
    assert len(found) == count
    assert sorted((i, n, f) for i, _, _, n, f in found) == sorted((known[k][0], s[1] - s[0], s[2][0]) for k in range(len(known)) if known[k] not in known[:k] for s in places.get(("spans", k), []))


def test_collisions_of_a_power_of_two_are_no_repeats(spark):
    """Words whose hashes modulo 2^64 are the same, whatever the base."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    rng = random.Random(1)
    before, after = prose(rng, 2), prose(rng, 2)
    assert substring_dedup.repeated_spans(table(spark, [(1, f"{before} {one} {after}"), (2, f"{before} {two} {after}")]), block=3, least=5).count() == 0
