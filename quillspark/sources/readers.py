"""Readers of the inputs that an index is built from, and of its catalogue and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch of listed files has at most so many of them, and ends once it has so many bytes; the rest makes further batches.
MOST_FILES, MOST_BYTES = 300_000, 200_000_000

#: Fetched pages of as many bytes or more are left out, which is what the filter is for.
PAGE_BYTES = 100_000_000

#: The document id of every word of a fuzzing input.
FUZZ_ID = 3

WAL = "timestamp long, ops array<struct<op:string,key:string,kind:string,s:string,n:double>>"


def listed_files(spark: SparkSession, listing: str, root: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, batch, name, text) of all files under root that a listing names, one relative path a line; ids count from 1.

    Files are taken in the listing's order into batches, counted from 0: one ends
    with the file by which it has most_bytes or most_files. Names that are no file
    are left out. The listing is one file, whose names the driver goes through.
    """
    lines = [r[0].strip() for r in spark.read.text(listing, wholetext=True).select(F.explode(F.split("value", "\n"))).collect()]
    names = [x for x in lines if x]
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
    rows, batch, count, total = [], 0, 0, 0
    for i, name in enumerate(names, 1):
        path = at(f"{root}/{name}")
        if not files.exists(path):
            continue
        rows.append((i, batch, name))
        count, total = count + 1, total + files.getFileStatus(path).getLen()
        if count >= most_files or total >= most_bytes:
            batch, count, total = batch + 1, 0, 0
    if not rows:
        return spark.createDataFrame([], "doc_id long, batch int, name string, text string")
    wanted = spark.createDataFrame(rows, "doc_id long, batch int, name string")
    held = spark.read.format("binaryFile").load([f"{root}/{n}" for n in dict.fromkeys(n for _, _, n in rows)])
    named = held.select(F.expr(f"substring(path, instr(path, '{root}/') + {len(root) + 1})").alias("name"), F.decode("content", "UTF-8").alias("text"))
    return wanted.join(named, "name").select("doc_id", "batch", "name", "text")


def framed_documents(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(doc_id, name, text) of the documents framed in a stream's whole text, ids counting from 0.

    A frame is: filename NAME /endfilename file TEXT /endfile; what follows
    /endindexing is not read. White space becomes single spaces in texts and
    vanishes from names.
    """
    stream = F.regexp_replace(F.col(value_col), "(?s)(^|\\s)/endindexing(\\s.*|$)", "")
    frame = "(?s)(?:^|\\s)filename\\s+(.*?)\\s*/endfilename\\s+file\\s+(.*?)\\s*/endfile(?=\\s|$)"
    found = lines.select(F.posexplode(F.arrays_zip(F.regexp_extract_all(stream, F.lit(frame), F.lit(1)).alias("name"), F.regexp_extract_all(stream, F.lit(frame), F.lit(2)).alias("text"))).alias("doc_id", "f"))
    fields = found.schema["f"].dataType.names
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.col("f")[fields[0]], "\\s+", "").alias("name"), F.trim(F.regexp_replace(F.col("f")[fields[1]], "\\s+", " ")).alias("text"))


def fuzzed_documents(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(doc_id, text): every word is a document, all of one id."""
    return lines.select(F.lit(FUZZ_ID).cast("long").alias("doc_id"), F.explode(F.split(F.trim(value_col), "\\s+")).alias("text")).where("text <> ''")


def catalogued_segments(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(segment) of a catalogue: a name a line, without empty lines and those that begin with a hash."""
    return lines.select(F.trim(value_col).alias("segment")).where("segment <> '' AND NOT startswith(segment, '#')")


def crawled_pages(pages: DataFrame, html_col: str = "html", status_col: str | None = None, type_col: str | None = None) -> DataFrame:
    """Pages worth keeping: fetched well, HTML, and under PAGE_BYTES."""
    keep = F.octet_length(html_col) < PAGE_BYTES
    if status_col:
        keep &= F.col(status_col) == 200
    if type_col:
        keep &= F.contains(type_col, F.lit("text/html"))
    return pages.where(keep)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Records (timestamp, ops) of a log of JSON lines."""
    return spark.read.schema(WAL).json(path)


def write_wal(wal: DataFrame, path: str) -> None:
    wal.select("timestamp", "ops").write.mode("append").json(path)


def read_sqlite(spark: SparkSession, path: str, table: str = "en", rows: int = 100_000) -> DataFrame:
    """(rowid, url, body_text) of a table of a SQLite file that all executors can open, for a copy into the document store; one range of rowids a task."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f'SELECT coalesce(min(rowid), 1), coalesce(max(rowid), 0) FROM "{table}"').fetchone()

    def read(batches):
        import sqlite3

        import pyarrow as pa

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    found = db.execute(f'SELECT rowid, url, body_text FROM "{table}" WHERE rowid >= ? AND rowid < ?', (first, first + rows)).fetchall()
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["rowid", "url", "body_text"])

    parts = max(1, -(-(high + 1 - low) // rows))
    return spark.range(low, high + 1, rows, parts).mapInArrow(read, "rowid long, url string, body_text string")
