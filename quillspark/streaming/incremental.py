"""Streams: documents that become segments batch by batch, and the tail of a write log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import index as ix
from quillspark.sources.readers import WAL


_LAST = "key string, ts long, op_no int, v struct<kind:string,s:string,n:double>"


def index_stream(docs: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """Index a stream of documents: each micro-batch becomes the segment of its number, once, and small segments are merged as they pile up.

    Returns the query, which ends once all that is there has been read.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"b{number}"
        if any(s.holds(name) for s in ix.catalogue(spark, path)[1]):
            return  # committed before the stream was cut off
        ix.write_index(batch.withColumn("_segment", F.lit(name)), path, "_segment", id_col, text_col)
        ix.compact(spark, path)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def wal_tail(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the records of a log folder."""
    return spark.readStream.schema(WAL).json(path)


def replay_stream(wal: DataFrame, path: str, checkpoint: str):
    """Keep the last write of each key of a log stream in a folder, a version of the table for each batch; returns the query.

    A batch's last writes are merged with the table before it, so only a batch is
    held at a time, and one that is repeated gives the same again. The version
    before the last one stays for readers.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ops = batch.select(F.col("timestamp").alias("ts"), F.posexplode("ops").alias("op_no", "o")).where("o.op = 'Write'")
        rows = ops.select(F.col("o.key").alias("key"), "ts", "op_no", F.struct("o.kind", "o.s", "o.n").alias("v"))
        if number:
            rows = rows.unionByName(spark.read.schema(_LAST).parquet(f"{path}/{number - 1}"))
        last = rows.groupBy("key").agg(F.max_by(F.struct("ts", "op_no", "v"), F.struct("ts", "op_no")).alias("r"))
        last.select("key", "r.*").write.mode("overwrite").parquet(f"{path}/{number}")
        at = spark._jvm.org.apache.hadoop.fs.Path
        at(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(at(f"{path}/{number - 2}"), True)

    return wal.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind, s, n) of the last version that replay_stream() has finished, deletions left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in files.listStatus(at(path)) if f.getPath().getName().isdigit() and files.exists(at(f"{f.getPath()}/_SUCCESS"))]
    return spark.read.schema(_LAST).parquet(f"{path}/{max(done)}").where("v.kind <> 'D'").select("key", "v.*")
