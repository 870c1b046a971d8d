"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of the templates of
benchmark items are joined by hash to the windows of every document; and a match
counts only where its slots agree: equal values of the item must stand for equal
values of the document, and different for different. So a question is caught
again with other numbers or names in it. A capital that opens a sentence may be a
name's or not, so there are two templates, one for each reading. Windows of the
plain words, whatever their case, are joined besides: what is capitals, names or
numbers for the most part has no template to speak of, but is found as an exact
copy. Items too short for a window are looked up as whole lines and texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StructField, StructType

from quillspark.llm.kernels import U64, Chunk, RangeHash, chunks, fold, mix64, ranges, row_of, runs
from quillspark.llm.runtime import BROADCAST_ROWS, free_name

#: Tokens in a window; shorter items, down to SHORTEST tokens, are one window each, and those below whole lines or texts.
WINDOW = 8
SHORTEST = 5

#: Share of a template window's tokens that must be words, not placeholders.
LITERAL = 0.5

#: Bytes of benchmark text in a part of its index, which is sent to every executor.
INDEX_BYTES = 1 << 26

UNITS = "mm cm m km kilometer kilometers kilometre kilometres meter meters metre metres centimeter centimeters inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp mph kph kmh hz khz mhz ghz w kw watt watts v volt volts j joule joules n newton newtons c f celsius fahrenheit kb mb gb tb byte bytes".split()

#: Numbers in words; not "one", which is a pronoun as often.
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_PLACEHOLDER = mix64(np.array([0, 11, 12, 13], dtype=U64))

_KIND = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 digit
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_CHARACTER = np.zeros(256, dtype=bool)  # leading bytes of scripts that are written without spaces
_CHARACTER[0xE3:0xEA] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, *map(ord, ".!?:;\"'([{|*-")]] = True


@dataclass
class Tokens:
    """Tokens of a chunk in order: bytes from start to end, value hash, kind, row; and which words have a capital that may only open a sentence."""

    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    row: np.ndarray
    opens: np.ndarray


@dataclass
class Reading:
    """A sequence of codes with kinds, values and rows, and the tokens, from first to past, that each stands for."""

    code: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    row: np.ndarray
    first: np.ndarray
    past: np.ndarray


def word_hash(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        out.append(RangeHash(data)(np.array([0]), np.array([len(data)]))[0])
    return np.array(out, dtype=U64)


_UNIT_HASHES = np.sort(word_hash(UNITS))
_NUMBER_HASHES = np.sort(word_hash(NUMBERS))


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_keys, keys)
    return sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == keys


def _characters(data: np.ndarray) -> np.ndarray:
    """Places of the leading bytes of characters that are tokens of their own: Han, Kana, Thai, Lao, Khmer, Burmese."""
    at = np.flatnonzero(data >= 0xE0)
    c0, c1 = data[at], data[np.minimum(at + 1, len(data) - 1)]
    own = _CHARACTER[c0] | ((c0 == 0xE0) & (c1 >= 0xB8) & (c1 <= 0xBB)) | ((c0 == 0xE1) & ((c1 <= 0x82) | (c1 == 0x9E) | (c1 == 0x9F))) | ((c0 == 0xF0) & (c1 >= 0xA0) & (c1 <= 0xB3))
    return at[own]


def tokens(chunk: Chunk) -> Tokens:
    """Words are runs of letters, or single characters of scripts without spaces; numbers are listed words or runs of digits, joined over single points and commas.

    A unit is a listed word right after a number; a name is a word with a capital
    that doesn't begin a text, a line or a sentence; one that does may be a name.
    """
    data, bounds = chunk.data, chunk.bounds
    kind = _KIND[data]
    own = _characters(data)
    if len(own):
        size = np.where(data[own] >= 0xF0, 4, 3)
        kind[ranges(own, np.minimum(size, len(data) - own))] = 0
    ls, le = runs(kind == 1, bounds)
    ds, de = runs(kind == 2, bounds)
    if len(ds):
        row = row_of(ds, bounds)
        joined = np.zeros(len(ds), dtype=bool)
        gap = ds[1:] - de[:-1] == 1
        between = data[np.minimum(de[:-1], len(data) - 1)]
        joined[1:] = gap & ((between == 46) | (between == 44)) & (row[1:] == row[:-1])
        first = np.flatnonzero(~joined)
        ds, de = ds[first], de[np.append(first[1:], len(de)) - 1]
    start, end, kinds = ls, le, np.zeros(len(ls), np.int8)
    if len(ds) or len(own):
        start = np.concatenate([ls, ds, own])
        end = np.concatenate([le, de, own + size if len(own) else own])
        kinds = np.concatenate([kinds, np.full(len(ds), NUMBER, np.int8), np.full(len(own), WORD, np.int8)])
        order = np.argsort(start, kind="stable")
        start, end, kinds = start[order], end[order], kinds[order]
    none = np.zeros(0, dtype=bool)
    if not len(start):
        return Tokens(start, end, np.zeros(0, U64), kinds, start, none)
    value = RangeHash(fold(data))(start, end)
    row = row_of(start, bounds)
    c0 = data[start]
    c1 = data[np.minimum(start + 1, len(data) - 1)]
    capital = ((c0 >= 65) & (c0 <= 90)) | ((c0 == 0xC3) & (c1 >= 0x80) & (c1 <= 0x9E))
    kinds[_among(_NUMBER_HASHES, value) & (kinds == WORD)] = NUMBER
    after = np.flatnonzero((kinds[:-1] == NUMBER) & (kinds[1:] == WORD) & (row[1:] == row[:-1])) + 1
    kinds[after[_among(_UNIT_HASHES, value[after])]] = UNIT
    named = np.flatnonzero(capital & (kinds == WORD))
    at = start[named] - 1
    low = bounds[row[named]]
    while True:  # back over spaces
        on = np.flatnonzero((at >= low) & _SPACE[data[np.maximum(at, 0)]])
        if not len(on):
            break
        at[on] -= 1
    opening = (at < low) | _STOP[data[np.maximum(at, 0)]]
    kinds[named[~opening]] = NAME
    opens = np.zeros(len(start), dtype=bool)
    opens[named[opening]] = True
    return Tokens(start, end, value, kinds, row, opens)


def plain(t: Tokens) -> Reading:
    """The values themselves, all as words."""
    at = np.arange(len(t.value))
    return Reading(t.value, np.zeros(len(at), np.int8), t.value, t.row, at, at + 1)


def template(t: Tokens, data: np.ndarray, opened: bool) -> Reading:
    """Placeholders for all but words, one for a run of names; words that open a sentence with a capital are names if so read."""
    kind = np.where(t.opens, NAME, t.kind) if opened else t.kind
    n = len(kind)
    if not n:
        return plain(t)
    goes_on = np.zeros(n, dtype=bool)
    both = np.flatnonzero((kind[1:] == NAME) & (kind[:-1] == NAME) & (t.row[1:] == t.row[:-1]) & (t.start[1:] - t.end[:-1] == 1)) + 1
    between = data[t.end[both - 1]]
    goes_on[both[(between == 32) | (between == 45)]] = True
    first = np.flatnonzero(~goes_on)
    past = np.append(first[1:], n)
    value = t.value[first]
    long = np.flatnonzero(past - first > 1)
    if len(long):
        value[long] = RangeHash(t.value)(first[long], past[long])
    kind = kind[first]
    return Reading(np.where(kind == WORD, value, _PLACEHOLDER[kind]), kind, value, t.row[first], first, past)


def windows(r: Reading, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and hash of each window of so many codes within a row that has words enough."""
    n = len(r.code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    words = np.concatenate([[0], np.cumsum(r.kind == WORD)])
    first = np.flatnonzero((r.row[:n] == r.row[size - 1 :]) & (words[size:] - words[:-size] >= LITERAL * size))
    return first, RangeHash(r.code)(first, first + size)


Held = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Index:
    """The benchmark's texts, each once: the ids of each; readings of all, plain words and two templates; and hashes.

    For plain words and for templates, and for each size of windows, sorted hashes
    with text and place; templates say also of which reading. short has the hashes of
    texts of fewer than SHORTEST tokens.
    """

    ids: list[list]
    readings: list[Reading]
    kind: np.ndarray
    first: np.ndarray
    plain: dict[int, Held] = field(default_factory=dict)
    templates: dict[int, Held] = field(default_factory=dict)
    short: dict[int, list[int]] = field(default_factory=dict)


def build_index(items: list[tuple], size: int = WINDOW) -> Index:
    """Index of (item, text) pairs."""
    ids: dict[str, list] = {}
    for i, text in items:
        if text:
            ids.setdefault(text, []).append(i)
    texts = pa.array(list(ids), pa.large_string())
    (c,) = chunks(texts, 1 << 62) if len(texts) else (Chunk(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)),)
    t = tokens(c)
    readings = [plain(t), template(t, c.data, False), template(t, c.data, True)]
    out = Index(list(ids.values()), readings, t.kind, np.searchsorted(t.row, np.arange(c.rows + 1)))
    found: list[dict[int, list[Held]]] = [{}, {}]
    for which, r in enumerate(readings):
        count = np.diff(np.searchsorted(r.row, np.arange(c.rows + 1)))
        for width in np.unique(np.minimum(count, size)).tolist():
            if width >= SHORTEST:
                first, h = windows(r, width)
                on = np.minimum(count, size)[r.row[first]] == width
                found[which > 0].setdefault(width, []).append((h[on], np.full(int(on.sum()), which), first[on]))
    for into, sizes in ((out.plain, found[0]), (out.templates, found[1])):
        for width, parts in sizes.items():
            h, which, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((first, which, h))
            into[width] = h[order], which[order], first[order]
    few = np.flatnonzero(np.diff(out.first) < SHORTEST)
    for row, h in zip(few.tolist(), _bare(c.data, c.bounds[few], c.bounds[few + 1]).tolist(), strict=True):
        if h:
            out.short.setdefault(h, []).append(row)
    return out


def _bare(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes without white space, case aside; 0 for those of nothing else."""
    size = end - start
    own = fold(data[ranges(start, size)])
    ink = own > 32
    at = np.concatenate([[0], np.cumsum(ink)])
    edge = np.concatenate([[0], np.cumsum(size)])
    a, z = at[edge[:-1]], at[edge[1:]]
    return np.where(z > a, RangeHash(own[ink])(a, z), U64(0))


def consistent(item_kind: np.ndarray, item_value: np.ndarray, doc_value: np.ndarray) -> bool:
    """Whether slots of one kind and value in the item have one value in the document, and different ones different."""
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    for k, a, b in zip(item_kind.tolist(), item_value.tolist(), doc_value.tolist(), strict=True):
        if k != WORD and (there.setdefault((k, a), b) != b or back.setdefault((k, b), a) != a):
            return False
    return True


Match = tuple[int, int, int, int, int, bool]


def matches(c: Chunk, index: Index) -> list[Match]:
    """(row, text's place, first token, tokens, slots, exact) of each match in a chunk that lies in no other of its row and text."""
    t = tokens(c)
    base = np.searchsorted(t.row, np.arange(c.rows + 1))
    found: dict[tuple[int, int], set[tuple[int, int, int, bool]]] = {}
    for which, r in enumerate((plain(t), template(t, c.data, False), template(t, c.data, True))):
        for size, held in (index.templates if which else index.plain).items():
            for row, own, shift, begin, end in _aligned(r, held, size):
                there = index.readings[own]
                text = int(there.row[begin - shift])
                for at, stop in _agreeing(r, there, size, shift, begin, end):
                    first, past = int(r.first[at]), int(r.past[stop - 1])
                    a, z = int(there.first[at - shift]), int(there.past[stop - 1 - shift])
                    slots = int((there.kind[at - shift : stop - shift] != WORD).sum()) if which else int((index.kind[a:z] != WORD).sum())
                    exact = bool((there.value[at - shift : stop - shift] == r.value[at:stop]).all())
                    found.setdefault((row, text), set()).add((first, past, slots, exact))
    out = []
    for (row, text), own in found.items():
        kept: list[tuple[int, int, int, bool]] = []
        for m in sorted(own, key=lambda m: (m[0] - m[1], not m[3], -m[2], m[0])):
            if not any(k[0] <= m[0] and m[1] <= k[1] for k in kept):
                kept.append(m)
        out += [(row, text, first - int(base[row]), past - first, slots, exact) for first, past, slots, exact in kept]
    return out + _short_ones(c, t, base, index)


def _short_ones(c: Chunk, t: Tokens, base: np.ndarray, index: Index) -> list[Match]:
    """Lines and texts that are a short item."""
    if not index.short or not len(c.data):
        return []
    ends = np.flatnonzero(c.data == 10)
    cut = np.union1d(c.bounds, ends + 1)
    start, end = np.concatenate([cut[:-1], c.bounds[:-1]]), np.concatenate([cut[1:], c.bounds[1:]])
    a, z = np.searchsorted(t.start, start), np.searchsorted(t.start, end)
    on = np.flatnonzero((z - a < SHORTEST) & (end > start))
    out = set()
    for k, h in zip(on.tolist(), _bare(c.data, start[on], end[on]).tolist(), strict=True):
        for text in index.short.get(h, ()):
            row = int(np.searchsorted(c.bounds, start[k], side="right")) - 1
            slots = int((t.kind[a[k] : z[k]] != WORD).sum())
            out.add((row, text, int(a[k] - base[row]), int(z[k] - a[k]), slots, True))
    return sorted(out)


def _aligned(r: Reading, held: Held, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, reading of the index, shift, first place, place past the last) of each run of overlapping or touching windows on one alignment that an index holds."""
    first, h = windows(r, size)
    keys, which, place = held
    table = np.zeros(1 << 20, dtype=bool)
    table[(keys >> U64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(h >> U64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
    runs_of: dict[tuple[int, int, int], list[int]] = {}
    for at, a, b in zip(first[maybe].tolist(), lo.tolist(), hi.tolist(), strict=True):
        for k in range(a, b):
            runs_of.setdefault((int(r.row[at]), int(which[k]), at - int(place[k])), []).append(at)
    for (row, own, shift), hits in runs_of.items():
        hits.sort()
        begin = hits[0]
        for k, at in enumerate(hits):
            if k + 1 < len(hits) and hits[k + 1] <= at + size:
                continue
            yield row, own, shift, begin, at + size
            if k + 1 < len(hits):
                begin = hits[k + 1]


def _agreeing(r: Reading, there: Reading, size: int, shift: int, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """The stretches from begin to end whose slots agree: all of it, else the longest from each window on."""
    at = begin
    while at + size <= end:
        stop = end
        while stop - at >= size and not consistent(there.kind[at - shift : stop - shift], there.value[at - shift : stop - shift], r.value[at:stop]):
            stop -= 1
        if stop - at >= size:
            yield at, stop
            at = stop
        else:
            at += 1


def load_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW, most: int = BROADCAST_ROWS, most_bytes: int = INDEX_BYTES) -> list[Index]:
    """The benchmark's index, in parts of about `most` items and `most_bytes` of text at most, each of which is sent to all executors in turn."""
    items = benchmark.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()
    parts = max(1, -(-n // most), -(-total // most_bytes))
    part = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(parts))
    return [build_index(sorted(map(tuple, items.where(part == p).collect()), key=repr), size) for p in range(parts)]  # of bounded count and bytes


def matched(index: Index, kind: DataType) -> Column:
    """An Arrow function from texts to arrays of (item_id, first_token, tokens, slots, exact)."""
    result = StructType([StructField("item_id", kind), StructField("first_token", IntegerType()), StructField("tokens", IntegerType()), StructField("slots", IntegerType()), StructField("exact", BooleanType())])
    arrow = pa.list_(to_arrow_type(result))

    def run(texts: pa.Array) -> pa.Array:
        found: list[list[tuple]] = [[] for _ in range(len(texts))]
        for c in chunks(texts):
            for row, text, *rest in sorted(matches(c, index)):
                found[c.lo + row] += [(i, *rest) for i in index.ids[text]]
        return pa.array([[dict(zip(result.names, m, strict=True)) for m in own] for own in found], arrow)

    return F.arrow_udf(run, ArrayType(result), F.ArrowUDFType.SCALAR)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, item_id, first_token, tokens, slots, exact) for every stretch of a document that repeats an item's template or its very words.

    A stretch is a run of overlapping windows on one alignment whose slots agree,
    of plain words or of a template in either reading; of a document and an item
    those are reported that lie in no other. exact tells whether all its values are
    the item's own. Characters of scripts without spaces are tokens each. An item of
    fewer than SHORTEST tokens is found where a line or a whole document is that
    item, case and white space aside; items between that and a window are one
    window. Null and empty texts, in either table, match nothing. Repeated items
    each match; repeated rows are reported again, null ids as null. Ids are of any
    type; an id column with the name of a result's gets "_" after it. Other columns
    are ignored. An empty table on either side gives no rows.
    """
    kind = benchmark.schema[item_col].dataType
    out = None
    for index in load_index(benchmark, item_col, item_text_col, size):
        rows = docs.select(F.col(id_col).alias("_id"), F.explode(matched(index, kind)(F.col(text_col))).alias("_m"))
        found = rows.select(F.col("_id").alias(free_name(id_col, "item_id", "first_token", "tokens", "slots", "exact")), "_m.*")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """docs without those in which contaminations() finds a stretch; all columns stay, and rows with null text."""
    for index in load_index(benchmark, item_col, item_text_col, size):
        docs = docs.where(F.size(matched(index, benchmark.schema[item_col].dataType)(F.col(text_col))) == 0)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
