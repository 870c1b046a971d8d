"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query of trigrams that any match must
hold. An index of the trigrams in question, built for each segment of about 1 MB of
texts and dropped with it, gives postings; their intersections and unions leave
candidate texts, on which the regex is run.
A rule without mandatory trigrams is run on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.kernels import _FOLD, Chunk, chunks
from quillspark.llm.runtime import free_name

#: (name, regex): of the syntax that Python's re and RE2 read alike.
RULES: list[tuple[str, str]] = [
    ("aws_access_key_id", r"\b(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[0-9A-Za-z]{36}\b"),
    ("github_fine_grained", r"\bgithub_pat_[0-9A-Za-z_]{60,}\b"),
    ("slack_token", r"\bxox[abeoprs]-[0-9A-Za-z-]{10,}"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    ("json_web_token", r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}"),
    ("assignment", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']?[0-9a-z_/+.-]{8,}"),
    ("bearer", r"(?i)\bbearer[ \t]+[0-9a-z_.=-]{20,}"),
    ("url_credentials", r"\b[a-z][a-z0-9+.-]{1,20}://[0-9A-Za-z._-]+:[0-9A-Za-z._~!$%-]{3,}@"),
    ("hex_key", r"\b(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b"),
]

#: What the SQL has in place of open ends: (rule, open, bounded). It is kept as it was, and cuts or misses longer secrets.
_BOUNDS = [
    ("github_fine_grained", "{60,}", "{60,90}"), ("slack_token", "{10,}", "{10,90}"), ("stripe_key", "{16,}", "{16,99}"), ("json_web_token", "{10,}", "{10,900}"), ("assignment", "{8,}", "{8,200}"),
    ("bearer", "{20,}", "{20,900}"), ("url_credentials", "_-]+:", "_-]{1,64}:"), ("url_credentials", "{3,}@", "{3,64}@"),
]

#: A query is True (any text), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple[str, tuple]

_SET_LIMIT = 32
_CLASS_LIMIT = 8


def _join(op: str, parts: list[Query]) -> Query:
    flat: list[Query] = []
    for p in parts:
        if p is True:
            if op == "or":
                return True
            continue
        flat += p[1] if isinstance(p, tuple) and p[0] == op else [p]
    flat = sorted(set(flat), key=repr)
    if not flat:
        return op == "and"
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _trigrams(strings: set[bytes]) -> Query:
    """What a text must hold if it has one of these strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


class _Info:
    """What is known of a part's matches, all in lower case."""

    def __init__(self, exact: set[bytes] | None, prefix: set[bytes], suffix: set[bytes], must: Query = True) -> None:
        self.exact, self.prefix, self.suffix, self.must = exact, prefix, suffix, must

    def settled(self) -> _Info:
        """The same with its exact set turned into prefix, suffix and a query."""
        if self.exact is None:
            return self
        must = _join("and", [self.must, _trigrams(self.exact)])
        return _Info(None, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact}, must)


def _anything() -> _Info:
    return _Info(None, {b""}, {b""})


def _of(strings: set[bytes]) -> _Info:
    return _Info(strings, strings, strings)


def _concat(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None:
        if len(a.exact) * len(b.exact) <= _SET_LIMIT:
            out = _of({x + y for x in a.exact for y in b.exact})
            out.must = _join("and", [a.must, b.must])
            return out
    left, right = a.exact if a.exact is not None else a.suffix, b.exact if b.exact is not None else b.prefix
    cross: Query = _trigrams({x + y for x in left for y in right}) if len(left) * len(right) <= 4 * _SET_LIMIT else True
    prefix = {x + y for x in a.exact for y in right} if a.exact is not None and len(a.exact) * len(right) <= _SET_LIMIT else a.settled().prefix
    suffix = {x + y for x in left for y in b.exact} if b.exact is not None and len(left) * len(b.exact) <= _SET_LIMIT else b.settled().suffix
    return _Info(None, prefix, suffix, _join("and", [a.settled().must, b.settled().must, cross]))


def _either(parts: list[_Info]) -> _Info:
    if all(p.exact is not None and p.must is True for p in parts):
        union = set().union(*(p.exact for p in parts))
        if len(union) <= _SET_LIMIT:
            return _of(union)
    parts = [p.settled() for p in parts]
    prefix, suffix = set().union(*(p.prefix for p in parts)), set().union(*(p.suffix for p in parts))
    return _Info(None, prefix if len(prefix) <= _SET_LIMIT else {b""}, suffix if len(suffix) <= _SET_LIMIT else {b""}, _join("or", [p.must for p in parts]))


def _class(items: list) -> _Info:
    chars: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(arg)
        elif op is sre.RANGE:
            chars.update(range(arg[0], arg[1] + 1))
        else:
            return _anything()
        if len(chars) > 255:
            return _anything()
    if any(x > 127 for x in chars):
        return _anything()
    folded = {bytes([x]).lower() for x in chars}
    return _of(folded) if len(folded) <= _CLASS_LIMIT else _anything()


def _analyse(tree) -> _Info:
    out = _of({b""})
    for op, arg in tree:
        if op is sre.LITERAL:
            part = _of({bytes([arg]).lower()}) if arg < 128 else _anything()
        elif op is sre.IN:
            part = _class(arg)
        elif op is sre.BRANCH:
            part = _either([_analyse(x) for x in arg[1]])
        elif op is sre.SUBPATTERN:
            part = _analyse(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            one = _analyse(body)
            if low == 0:
                part = _either([_of({b""}), one]) if high == 1 else _anything()
            else:
                part = one
                for _ in range(min(low, 4) - 1):
                    part = _concat(part, one)
                if high > min(low, 4):
                    part = _concat(part, _anything())
        elif op is sre.ATOMIC_GROUP:
            part = _analyse(arg)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = _of({b""})
        else:
            part = _anything()
        out = _concat(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query, in lower case, that every text with a match fulfils; True if there is none."""
    info = _analyse(_parser.parse(pattern))
    ends = [_trigrams(s) for s in (info.prefix, info.suffix)] if info.exact is None else [_trigrams(info.exact)]
    return _join("and", [info.must, *ends])


def needed(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(needed, query[1])) if isinstance(query, tuple) else set()


def code(trigram: bytes) -> int:
    return trigram[0] | trigram[1] << 8 | trigram[2] << 16


def postings(chunk: Chunk, table: np.ndarray) -> dict[int, np.ndarray]:
    """Sorted rows of a segment for each trigram that the table marks; case is folded, no trigram passes a row."""
    data = _FOLD[chunk.data]
    if len(data) < 3:
        return {}
    codes = data[:-2].astype(np.int32)
    codes |= data[1:-1].astype(np.int32) << 8
    codes |= data[2:].astype(np.int32) << 16
    at = np.flatnonzero(table[codes])
    row = np.searchsorted(chunk.bounds, at, side="right") - 1
    inside = at + 3 <= chunk.bounds[row + 1]
    keys = np.unique(codes[at[inside]].astype(np.int64) << 32 | row[inside])
    tri, rows = keys >> 32, keys & 0xFFFFFFFF
    if not len(tri):
        return {}
    first = np.flatnonzero(np.concatenate([[True], tri[1:] != tri[:-1]]))
    return {int(tri[a]): rows[a:b] for a, b in zip(first, np.append(first[1:], len(tri)), strict=True)}


def candidates(query: Query, index: dict[int, np.ndarray], rows: int) -> np.ndarray:
    """Sorted rows of a segment that fulfil a query."""
    if query is True:
        return np.arange(rows)
    if query is False:
        return np.zeros(0, np.int64)
    if isinstance(query, bytes):
        return index.get(code(query), np.zeros(0, np.int64))
    parts = [candidates(q, index, rows) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    out = parts[0]
    for p in parts[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def find_secrets(texts: pa.Array, rules: list[tuple[str, str]]) -> Iterator[tuple[int, str, int, str]]:
    """(row, rule, number from 1, match) of all matches."""
    compiled = [(name, re.compile(pattern, re.ASCII if pattern.isascii() else 0), trigram_query(pattern)) for name, pattern in rules]
    table = np.zeros(1 << 24, dtype=bool)
    for _, _, query in compiled:
        for t in needed(query):
            table[code(t)] = True
    for c in chunks(texts):
        index = postings(c, table)
        for name, pattern, query in compiled:
            for row in candidates(query, index, c.rows).tolist():
                text = c.data[c.bounds[row] : c.bounds[row + 1]].tobytes().decode("utf-8", "replace")
                for k, m in enumerate(pattern.finditer(text), 1):
                    yield c.lo + row, name, k, m.group()


def scan_secrets(docs: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, match_no, secret) for every match of every rule, numbered from 1 in a text.

    Matches of one rule don't overlap; those of different rules may. Rules are
    matched on characters; in a rule of ASCII characters alone, classes, word borders
    and case are those of ASCII, else those of Unicode. Null and
    empty texts have none. Repeated rows are reported again, null ids as null.
    An id column with the name of a result's gets "_" after it. Other columns are
    ignored. An empty table or no rules give no rows.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(find_secrets(b.column(1), rules))
            rows, names, numbers, secrets = zip(*found, strict=True) if found else ((), (), (), ())
            ids = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(secrets, pa.string())], names=["_id", "rule", "match_no", "secret"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.mapInArrow(run, f"_id {kind.simpleString()}, rule string, match_no int, secret string")
    return found.select(F.col("_id").alias(free_name(id_col, "rule", "match_no", "secret")), "rule", "match_no", "secret")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    """SQL that gives the same rows where no secret is longer than _BOUNDS."""
    bounded = dict(RULES)
    for name, free, bound in _BOUNDS:
        bounded[name] = bounded[name].replace(free, bound)
    one = " UNION ALL ".join("SELECT doc_id, '{}' AS rule, regexp_extract_all(text, '{}') AS found FROM documents".format(name, pattern.replace("'", "''")) for name, pattern in bounded.items())
    return f"SELECT doc_id, rule, unnest(range(1, len(found) + 1))::INT AS match_no, unnest(found) AS secret FROM ({one}) WHERE len(found) > 0"
