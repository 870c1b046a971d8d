"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One linear classifier a bit, over hashed
byte trigrams, is fitted on a bounded sample of labelled rows. A text gets the
codeword with the least weighted loss of its bits; where another codeword is
nearly as good, or nothing was seen to judge by, the answer is ambiguous.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.kernels import Chunk, chunks, fold
from quillspark.llm.runtime import free_name

FEATURES = 1 << 13

#: Labelled rows a language, about, on which the classifiers are fitted; rows in all; and the bytes of the longest text that is taken for it.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_ROWS = 1 << 13
SAMPLE_TEXT = 1 << 16

#: Least lead of the best codeword's loss over the next for a clear answer.
MARGIN = 0.05


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: all splits of the languages for up to six, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        bits = np.array([[(s >> k) & 1 for s in splits] for k in range(n - 1)] + [[0] * len(splits)])
        return (1 - 2 * bits).astype(np.float32)
    rng = np.random.default_rng(n)
    width = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1.0
    for _ in range(200):
        code = np.where(rng.random((n, width)) < 0.5, -1, 1).astype(np.float32)
        gap = (width - (code @ code.T)[np.triu_indices(n, 1)].max()) / 2
        if gap > far:
            best, far = code, gap
    return best


def trigram_buckets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each position that holds a letter, and each row's number of them.

    A row is framed by spaces; a run of anything but letters counts as one space.
    """
    data = fold(chunk.data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    before = np.zeros(len(data), dtype=bool)
    before[1:] = letter[:-1]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[chunk.bounds] = True
    before &= ~first[: len(data)]
    at = np.flatnonzero(letter | before)
    row = np.searchsorted(chunk.bounds, at, side="right") - 1
    # a space before each row; one after it too, unless it has ended with one
    size = np.bincount(row, minlength=chunk.rows)
    start = np.concatenate([[0], np.cumsum(size + 2)])
    sym = np.full(start[-1], 32, dtype=np.uint8)
    sym[start[row] + 1 + np.arange(len(at)) - np.concatenate([[0], np.cumsum(size)])[row]] = np.where(letter, data, 32)[at]
    middle = np.flatnonzero(sym != 32)
    code = sym[middle - 1].astype(np.uint32) | (sym[middle].astype(np.uint32) << 8) | (sym[middle + 1].astype(np.uint32) << 16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(19)
    return bucket.astype(np.int64), np.bincount(np.searchsorted(start, middle, side="right") - 1, minlength=chunk.rows)


def features(texts: list[str]) -> np.ndarray:
    """Share of each bucket among a text's trigrams, its root taken."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for c in chunks(pa.array(texts, pa.string())):
        bucket, counts = trigram_buckets(c)
        row = np.repeat(np.arange(c.rows), counts)
        got = np.bincount(row * FEATURES + bucket, minlength=c.rows * FEATURES).reshape(c.rows, FEATURES)
        out[c.lo : c.hi] = got / np.maximum(counts, 1)[:, None]
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray  # FEATURES x bits
    offset: np.ndarray
    trust: np.ndarray  # a weight for each bit's loss


def fit(texts: list[str], labels: list[str], rounds: int = 300, rate: float = 0.5) -> Model:
    """Logistic classifiers, one a bit, by accelerated gradient steps; each bit's trust falls with its error."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    x = features(texts)
    scale = 1 / np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-3)
    x *= scale
    y = code[[languages.index(label) for label in labels]]
    share = np.array([labels.count(name) for name in languages], dtype=np.float32)
    w = (len(labels) / (len(languages) * share))[[languages.index(label) for label in labels]][:, None] / max(1, len(labels))
    weight = np.zeros((FEATURES, code.shape[1]), dtype=np.float32)
    offset = np.zeros(code.shape[1], dtype=np.float32)
    step = rate / max(1e-6, float((x**2).sum(axis=1).mean()) / 4)
    old = weight.copy()
    for k in range(rounds):
        ahead = weight + (k / (k + 3)) * (weight - old)
        old = weight
        z = np.clip((x @ ahead + offset) * y, -30, 30)
        pull = -y * w / (1 + np.exp(z))
        weight = ahead - step * (x.T @ pull + 1e-5 * ahead)
        offset = offset - np.float32(0.5) * pull.sum(axis=0)
    wrong = (((x @ weight + offset) * y) <= 0).mean(axis=0)
    trust = np.log((1 - np.clip(wrong, 1e-3, 0.49)) / np.clip(wrong, 1e-3, 0.49))
    return Model(languages, code, (weight * scale[:, None]).astype(np.float32), offset, (trust / trust.sum()).astype(np.float32))


def decode(model: Model, votes: np.ndarray, seen: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language's place (-1 for none), lead over the second, and whether that is ambiguous."""
    loss = np.stack([(np.log1p(np.exp(-np.clip(votes * word, -30, 30))) * model.trust).sum(axis=1) for word in model.code], axis=1)
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    rows = np.arange(len(loss))
    lead = loss[rows, order[:, 1]] - loss[rows, best] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    lead = np.where(seen > 0, lead, 0.0)
    return np.where(seen > 0, best, -1), lead, (seen == 0) | (lead < margin)


def score(model: Model, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    bucket, counts = trigram_buckets(c)
    bits = model.code.shape[1]
    total = np.zeros((c.rows, bits), dtype=np.float64)
    rows = np.flatnonzero(counts)
    if len(rows):
        starts = np.concatenate([[0], np.cumsum(counts[rows])[:-1]])
        for b in range(bits):
            total[rows, b] = np.add.reduceat(model.weight[:, b].astype(np.float64)[bucket], starts)
    return total / np.maximum(counts, 1)[:, None] + model.offset, counts


RESULT = "struct<language:string,lead:double,ambiguous:boolean>"


def verdict(model: Model, margin: float = MARGIN) -> Callable[..., Column]:
    """An Arrow function from a column of texts to RESULT."""
    names = np.array([*model.languages, None], dtype=object)

    def run(texts: pa.Array) -> pa.Array:
        name, lead, unsure = [], [], []
        for c in chunks(texts):
            votes, seen = score(model, c)
            best, gap, doubt = decode(model, votes, seen, margin)
            name += names[best].tolist()
            lead += np.round(gap, 6).tolist()
            unsure += doubt.tolist()
        return pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(lead, pa.float64()), pa.array(unsure, pa.bool_())], names=["language", "lead", "ambiguous"])

    return F.arrow_udf(run, RESULT, F.ArrowUDFType.SCALAR)


def labelled_sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """About per_language texts of each language, fewer if SAMPLE_ROWS don't hold as many: those rows whose id and text hash lowest, in a fixed order.

    Texts of more than SAMPLE_TEXT bytes are not taken, equal rows once.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.octet_length(F.col(text_col)).between(1, SAMPLE_TEXT))
    key = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(2**62 - 1)
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).agg(F.approx_count_distinct(key)).collect()}  # one row a language
    per_language = max(1, min(per_language, SAMPLE_ROWS // max(1, len(counts))))
    rows = []
    if counts:
        limit = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, int(min(1.0, 2 * per_language / n) * (2**62 - 1)))])
        low = labelled.select(key.alias("_key"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where(F.col("_key") <= limit[F.col("_lang")])
        rows = sorted(low.dropDuplicates(["_lang", "_key"]).collect())  # about two per_language rows a language
    taken: dict[str, int] = {}
    texts, labels = [], []
    for _, lang, text in rows:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= per_language:
            texts.append(text)
            labels.append(lang)
    return texts, labels


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model fitted on at most per_language labelled rows of each language; None without any."""
    texts, labels = labelled_sample(docs, per_language, id_col, text_col, lang_col)
    return fit(texts, labels) if texts else None


def identify_languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """For every row: id, language, lead, ambiguous.

    lead is by how much the next codeword's loss exceeds the best one's;
    ambiguous means a lead under margin. A text without letters, empty or null,
    has a null language, lead 0 and is ambiguous, as is any text when there is
    no model. Of codewords with equal loss the first by name is taken, with lead
    0. Repeated rows are reported again, null ids as null. An id column with the
    name of a result's gets "_" after it. Other columns are ignored. An empty table
    gives no rows.
    """
    found = verdict(model, margin)(F.col(text_col)) if model else F.lit(None).cast(RESULT)
    rows = docs.select(F.col(id_col).alias("_id"), found.alias("_found"))
    return rows.select(F.col("_id").alias(free_name(id_col, "language", "lead", "ambiguous")), F.col("_found.language").alias("language"), F.coalesce("_found.lead", F.lit(0.0)).alias("lead"), F.coalesce("_found.ambiguous", F.lit(True)).alias("ambiguous"))


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs without the rows whose language can't be told; all columns stay.

    A row goes if identify_languages() finds it ambiguous: its text has no letters
    to judge by, or the lead is less than margin. Without a model every row goes.
    """
    if model is None:
        return docs.limit(0)
    found = verdict(model, margin)(F.col(text_col))
    return docs.where(~found.getField("ambiguous"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_languages(docs, train(docs))
