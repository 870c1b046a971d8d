"""Building, tiering, merging and checking inverted-index segments.

A segment has two tables: postings (segment, term, doc_id, tf, places), whose rows
hold a term's positions in a document, and terms (segment, term, term_ord, k27,
is_stub, df, cf). They are written by segment, a segment's documents dealt to files
by their ids and each file sorted by term, so that a query reads the pages of its
terms only, and positions only where it asks for them. A segment is as large as what
it is made of: no task ever holds all of its terms, nor all documents of a term.
A folder's catalogue names the segments that it has; what it doesn't name isn't
there, so one small file, written last, publishes a change as a whole.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.storage import new_path

STUB_EVERY = 10
TIER_BLOCK = 256

#: Segments before some are merged.
MOST_SEGMENTS = 8

#: Bytes of input that a task of a write takes, about; bytes of input that a position counts for; and segments whose names are listed to deal their documents evenly.
TASK_BYTES, POSITION_BYTES, LISTED_SEGMENTS = 1 << 22, 2, 1000

#: Letters of a term by which terms are numbered apart.
HEAD_LETTERS = 4

#: An estimate above this is none.
_UNKNOWN_BYTES = 1 << 60

POSTINGS = "segment string, term string, doc_id long, tf int, places array<int>"
TERMS = "segment string, term string, term_ord long, k27 long, is_stub boolean, df long, cf long"


def grouped_terms(docs: DataFrame, segment: str | None = None, id_col: str = "doc_id", text_col: str = "text", stop_words: bool = True) -> DataFrame:
    """(segment, term, doc_id, tf, places) of every index term of every document, without a shuffle.

    segment names a column of docs; without it all rows are of segment '0'. Null
    and empty texts have no terms. Rows that share an id each have rows of their own.
    """
    from quillspark.functions.postings import postings_batches

    name = F.col(segment).cast("string") if segment else F.lit("0")
    rows = docs.select(name.alias("segment"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(lambda batches: postings_batches(batches, stop_words), POSTINGS)


def positions_of(docs: DataFrame, segment: str | None = None, id_col: str = "doc_id", text_col: str = "text", stop_words: bool = True) -> DataFrame:
    """(segment, term, doc_id, pos) of every index term of every document."""
    return _places(grouped_terms(docs, segment, id_col, text_col, stop_words))


def _places(postings: DataFrame) -> DataFrame:
    return postings.select("segment", "term", "doc_id", F.explode("places").alias("pos"))


def stop_word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, with_stop_words, kept): how many index terms each document has with its stop words, and without."""
    from quillspark.functions.postings import stop_word_batches

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(stop_word_batches, "doc_id long, with_stop_words int, kept int")


def term_frequencies(positions: DataFrame) -> DataFrame:
    """(segment, term, doc_id, tf) of positions; a document's terms lie together, so most of the counting is done before the shuffle."""
    return positions.groupBy("segment", "term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """(segment, term, df, cf)."""
    return postings.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def numbered_terms(vocab: DataFrame) -> DataFrame:
    """vocab with term_ord (place in the segment from 0), k27 and is_stub (every tenth term, and the last).

    Terms with the same first HEAD_LETTERS are sorted together; what comes before
    them is counted over those beginnings, of which a segment has 27 ** HEAD_LETTERS
    at most. vocab is computed twice, once for the counts.
    """
    headed = vocab.withColumn("_head", F.left("term", F.lit(HEAD_LETTERS)))
    whole = Window.partitionBy("segment")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = headed.groupBy("segment", "_head").agg(F.count(F.lit(1)).alias("_n")).select("segment", "_head", before.alias("_first"), F.sum("_n").over(whole).alias("_all"))
    order = Window.partitionBy("segment", "_head").orderBy("term")
    ranked = headed.withColumn("_i", F.row_number().over(order)).join(heads, ["segment", "_head"]).withColumn("term_ord", F.col("_first") + F.col("_i") - 1)
    stub = (F.col("term_ord") % STUB_EVERY == 0) | (F.col("term_ord") == F.col("_all") - 1)
    return ranked.select("segment", "term", "term_ord", T.term_key(F.col("term")).alias("k27"), stub.alias("is_stub"), "df", "cf")


def tier_blocks(postings: DataFrame) -> DataFrame:
    """postings with tier: blocks of TIER_BLOCK documents of a term, by rising tf, then doc_id. One sort a term and segment, of a few bytes a document."""
    order = Window.partitionBy("segment", "term").orderBy("tf", "doc_id")
    return postings.withColumn("tier", F.floor((F.row_number().over(order) - 1) / TIER_BLOCK).cast("int"))


def tier(tiers: DataFrame, term: str, number: int) -> DataFrame:
    """(segment, doc_id, tf) of one block of a term's tier_blocks(), by tf, then doc_id: what a caller steps through block by block."""
    return tiers.where((F.col("term") == term) & (F.col("tier") == number)).select("segment", "doc_id", "tf").orderBy("segment", "tf", "doc_id")


@dataclass
class Index:
    """The tables of some segments; for those of a folder's catalogue, the folder and the catalogue's number."""

    terms: DataFrame
    postings: DataFrame
    positions: DataFrame
    path: str | None = None
    number: int | None = None

    def of(self, *segments: str) -> Index:
        on = F.col("segment").isin(*segments)
        return Index(self.terms.where(on), self.postings.where(on), self.positions.where(on))


def _indexed(postings: DataFrame, path: str | None = None, terms: DataFrame | None = None, number: int | None = None) -> Index:
    plain = postings.drop("places")
    return Index(numbered_terms(vocabulary(plain)) if terms is None else terms, plain, _places(postings), path, number)


def build(docs: DataFrame, segment: str | None = None, id_col: str = "doc_id", text_col: str = "text", stop_words: bool = True) -> Index:
    """An index as a plan; nothing is written. Ids must be unique."""
    return _indexed(grouped_terms(docs, segment, id_col, text_col, stop_words))


# the folder of an index ---


@dataclass(frozen=True)
class Segment:
    """A segment of a catalogue: its name, the version of its data, how many positions it has, and the names of those that were merged into it."""

    name: str
    version: str
    size: int
    of: tuple[str, ...] = ()

    def holds(self, name: str) -> bool:
        """Whether documents that were added under a name, or a numbered part of it, are in here."""
        return any(x == name or (x.startswith(f"{name}.") and x[len(name) + 1 :].isdigit()) for x in (self.name, *self.of))


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def catalogue(spark: SparkSession, path: str) -> tuple[int, list[Segment]]:
    """The number of a folder's last catalogue, 0 if there is none, and the segments in it."""
    at, files = _files(spark, path)
    folder = at(f"{path}/catalogue")
    numbers = [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()] if files.exists(folder) else []
    if not numbers:
        return 0, []
    rows = spark.read.text(f"{path}/catalogue/{max(numbers):012d}").collect()  # one row a segment
    found = [json.loads(r[0]) for r in rows]
    return max(numbers), [Segment(**(f | {"of": tuple(f["of"])})) for f in found]


def _commit(spark: SparkSession, path: str, number: int, segments: list[Segment]) -> None:
    """Write the catalogue that follows the one of that number: a file under another name, renamed; only one writer can win."""
    at, files = _files(spark, path)
    files.mkdirs(at(f"{path}/catalogue"))
    draft, final = at(f"{path}/catalogue/_{uuid.uuid4().hex}"), at(f"{path}/catalogue/{number + 1:012d}")
    out = files.create(draft, False)
    out.write(bytearray("".join(json.dumps(s.__dict__) + "\n" for s in segments).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError("another writer has changed the index; try again")


def _folder(spark: SparkSession, path: str, table: str, s: Segment) -> str:
    """Where a segment's rows of a table are."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(s.name)
    return f"{path}/{table}/version={s.version}/segment={name}"


def _rows(spark: SparkSession, path: str, table: str, schema: str, segments: list[Segment]) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(f"{schema}, version string").option("basePath", f"{path}/{table}")
    return reader.parquet(*[_folder(spark, path, table, s) for s in segments]).drop("version")


def _opened(spark: SparkSession, path: str, segments: list[Segment], number: int | None = None) -> Index:
    return _indexed(_rows(spark, path, "postings", POSTINGS, segments), path, _rows(spark, path, "terms", TERMS, segments), number)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index of a folder, as its last catalogue has it."""
    number, segments = catalogue(spark, path)
    return _opened(spark, path, segments, number)


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """The rows (segment, doc_id, ...), about so many bytes, in as many tasks as they need: each segment's by a hash of their ids, so that no task gathers a term or a segment."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    names = sorted(r[0] for r in rows.select("segment").distinct().limit(LISTED_SEGMENTS + 1).collect())
    if not names:
        return rows
    if len(names) > LISTED_SEGMENTS:
        return rows.repartition(tasks, "segment", F.pmod(F.xxhash64("doc_id"), F.lit(-(-tasks // LISTED_SEGMENTS))))
    each = -(-tasks // len(names))
    first = (F.array_position(F.array(*map(F.lit, names)), F.col("segment")) - 1) * each
    return rows.repartitionById(len(names) * each, (first + F.pmod(F.xxhash64("doc_id"), F.lit(each))).cast("int"))


def _write(postings: DataFrame, path: str, vocab: DataFrame | None = None) -> list[Segment]:
    """Write the postings and the terms of some segments, which no catalogue names yet; vocab is their vocabulary() where that is known."""
    spark = postings.sparkSession
    version = uuid.uuid4().hex
    postings.sortWithinPartitions("segment", "term", "doc_id").write.partitionBy("segment").parquet(f"{path}/postings/version={version}")
    at, files = _files(spark, path)
    folders = files.globStatus(at(f"{path}/postings/version={version}/segment=*")) or []
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [unescape(f.getPath().getName().removeprefix("segment=")) for f in folders]
    if not names:
        return []
    fresh = [Segment(n, version, 0) for n in names]
    draft = f"{path}/draft-{version}"  # for numbering, which reads it twice
    found = vocabulary(_rows(spark, path, "postings", POSTINGS, fresh)) if vocab is None else vocab
    found.select("segment", "term", "df", "cf").write.parquet(draft)
    held = spark.read.schema("segment string, term string, df long, cf long").parquet(draft)
    numbered_terms(held).sortWithinPartitions("segment", "term").write.partitionBy("segment").parquet(f"{path}/terms/version={version}")
    sizes = dict(held.groupBy("segment").agg(F.sum("cf")).collect())  # one row a segment
    files.delete(at(draft), True)
    return [Segment(n, version, int(sizes[n])) for n in names]


def _input_bytes(docs: DataFrame, text_col: str) -> int:
    """How large the input is: the optimiser's estimate, or the bytes of its texts where it has none."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < _UNKNOWN_BYTES else docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]


def write_index(docs: DataFrame, path: str, segment: str | None = None, id_col: str = "doc_id", text_col: str = "text", stop_words: bool = True, replace: bool = False, most_bytes: int | None = None) -> Index:
    """Build an index of the documents and add it to a folder; ids must be unique over all of its segments.

    Texts are shuffled once, to tasks of about TASK_BYTES. A segment is one
    whatever its size; only a caller who gives most_bytes has each cut by a hash of
    the ids into several, 'NAME.0', 'NAME.1' and so on, if the input has more. One
    that is there already is an error, or with replace is replaced, and all its
    parts with it. Readers see all of the new segments or none.
    """
    spark = docs.sparkSession
    size = _input_bytes(docs.select(*{id_col, text_col}), text_col)
    parts = -(-size // most_bytes) if most_bytes else 1
    name = F.coalesce(F.col(segment).cast("string"), F.lit("0")) if segment else F.lit("0")
    if parts > 1:
        name = F.concat(name, F.lit("."), F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)))
    rows = docs.select(name.alias("segment"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    fresh = _write(grouped_terms(_dealt(rows, size), "segment", stop_words=stop_words), path)
    number, there = catalogue(spark, path)
    names = {s.name.rsplit(".", 1)[0] if parts > 1 else s.name for s in fresh}
    gone = [s for s in there if any(s.holds(n) for n in names)]
    if gone and not replace:
        _remove(spark, path, fresh)
        raise ValueError(f"the index has this already: {gone[0].name}")
    _commit(spark, path, number, [s for s in there if s not in gone] + fresh)
    _remove(spark, path, gone)
    return open_index(spark, path)


def _remove(spark: SparkSession, path: str, segments: list[Segment]) -> None:
    at, files = _files(spark, path)
    for s in segments:
        for table in ("postings", "terms"):
            files.delete(at(_folder(spark, path, table, s)), True)


def merge_segments(index: Index, segments: list[str], into: str) -> Index:
    """The index with these segments made one; ids stay, the rest is as it was. A plan: write it to keep it."""
    if not segments:
        return index
    name = F.when(F.col("segment").isin(*segments), F.lit(into)).otherwise(F.col("segment"))
    positions = index.positions.withColumn("segment", name)
    postings = index.postings.withColumn("segment", name)
    return Index(numbered_terms(_summed(index.terms.withColumn("segment", name))), postings, positions)


def _summed(terms: DataFrame) -> DataFrame:
    """vocabulary() of the terms of segments that have been made one."""
    return terms.groupBy("segment", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def compact(spark: SparkSession, path: str, most: int = MOST_SEGMENTS, most_size: int | None = None) -> Index:
    """The index of a folder, its smallest segments merged in place for as long as it has more than `most`.

    Only the merged segments are read and written; their folders go once the new
    catalogue is there. Where most_size is given, segments that together would have
    more positions than that stay apart.
    """
    number, there = catalogue(spark, path)
    while len(there) > most:
        by_size = sorted(there, key=lambda s: (s.size, s.name))
        some, total = [], 0
        for s in by_size[: len(there) - most + 1]:
            if most_size is not None and total + s.size > most_size:
                break
            some.append(s)
            total += s.size
        if len(some) < 2:
            break
        into = F.lit(f"merged-{uuid.uuid4().hex}")
        postings, terms = (_rows(spark, path, table, schema, some).withColumn("segment", into) for table, schema in (("postings", POSTINGS), ("terms", TERMS)))
        fresh = _write(_dealt(postings, total * POSITION_BYTES), path, _summed(terms))
        of = tuple(sorted({n for s in some for n in (s.name, *s.of)}))
        there = [s for s in there if s not in some] + [Segment(s.name, s.version, s.size, of) for s in fresh]
        _commit(spark, path, number, there)
        number += 1
        _remove(spark, path, some)
    return _opened(spark, path, there, number)


def inconsistencies(index: Index) -> DataFrame:
    """(segment, problem, n) for each kind of fault: unsorted ordinals or keys, counts that differ between tables. No rows if all is well."""
    order = Window.partitionBy("segment").orderBy("term_ord")
    terms = index.terms.withColumn("_before", F.lag("term").over(order)).withColumn("_key", F.lag("k27").over(order))
    unsorted = terms.where((F.col("_before") >= F.col("term")) | (F.col("_key") > F.col("k27"))).select("segment", F.lit("unsorted").alias("problem"))
    counted = index.positions.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("_n"))
    wrong = index.terms.join(counted, ["segment", "term"], "full").where(~F.col("cf").eqNullSafe(F.col("_n"))).select("segment", F.lit("positions").alias("problem"))
    held = index.postings.groupBy("segment", "term").agg(F.sum("tf").alias("_n"), F.count(F.lit(1)).alias("_df"))
    differs = index.terms.join(held, ["segment", "term"], "full").where(~F.col("cf").eqNullSafe(F.col("_n")) | ~F.col("df").eqNullSafe(F.col("_df"))).select("segment", F.lit("postings").alias("problem"))
    return unsorted.unionByName(wrong).unionByName(differs).groupBy("segment", "problem").agg(F.count(F.lit(1)).alias("n"))


class IndexBuilder:
    """Collects documents and writes them as segments of one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, stop_words: bool = True) -> None:
        self.spark, self.stop_words = spark, stop_words
        self.path = path or new_path(spark, "index")
        self._parts: list[DataFrame] = []
        self._built = 0

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> IndexBuilder:
        self._parts.append(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
        return self

    def append_text(self, text: str, doc_id: int) -> IndexBuilder:
        """One document; it ends at its first NUL."""
        return self.append(self.spark.createDataFrame([(doc_id, text.split("\0")[0])], "doc_id long, text string"))

    def concat(self, other: IndexBuilder) -> IndexBuilder:
        self._parts += other._parts
        return self

    def persist(self, name: str | None = None) -> Index | None:
        """Write what was appended as one segment; None if that is nothing."""
        if not self._parts:
            return None
        docs = self._parts[0]
        for part in self._parts[1:]:
            docs = docs.unionByName(part)
        self._parts = []
        self._built += 1
        return write_index(docs.withColumn("_segment", F.lit(name or f"s{self._built}")), self.path, "_segment", stop_words=self.stop_words)
