"""Tables written once and read many times, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes in their strings, of a table that may be sent whole to every executor.
BROADCAST_ROWS = 1 << 20
BROADCAST_BYTES = 1 << 26


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder made for this session only where nothing is set on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that written() has made in this process.
_MADE: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; to be called once nothing that was built on them is read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    while _MADE:
        path = at(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, computed once and read from a table in the shared folder, which stays there until clear()."""
    path = new_path(df.sparkSession, name)
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows and bytes in strings; else left to a shuffled join."""
    wide = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    count, total = df.agg(F.count(F.lit(1)), sum(wide, F.lit(0).cast("long"))).first()
    return F.broadcast(df) if count <= rows and total <= most_bytes else df


#: Rows that a step of a query may hold on the driver to narrow the next step's scan.
HELD_ROWS = 1000


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a relation of the plan itself, with no job behind it."""
    fields = [x.split() for x in schema.split(", ")]
    if not rows:
        return spark.createDataFrame([], schema)
    cells = [F.struct(*[F.lit(x).cast(kind).alias(name) for x, (name, kind) in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*cells)))


def held(df: DataFrame) -> tuple[DataFrame, list | None]:
    """df and its rows if they are few, so that a later step can be narrowed by them; else df alone."""
    rows = df.limit(HELD_ROWS + 1).collect()
    if len(rows) > HELD_ROWS:
        return df, None
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return local_rows(df.sparkSession, [tuple(r) for r in rows], schema), rows


def free_name(name: str, *taken: str) -> str:
    """The name, with "_" after it for as long as it is one of those taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
