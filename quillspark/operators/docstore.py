"""The document store, the names of documents, and lookups in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T

NOT_FOUND = "File not found"


class DocumentStore:
    """A table (id, url, contents) in a folder: rows are added, never changed; of an id's rows the first one counts."""

    SCHEMA = "id long, url string, contents string, added long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._added = 0

    def insert(self, docs: DataFrame, id_col: str = "id", url_col: str = "url", text_col: str = "contents") -> None:
        """Add rows; urls and contents without quotes, backslashes and characters beyond ASCII."""
        self._added += 1
        clean = docs.select(F.col(id_col).cast("long").alias("id"), T.ascii_for_store(F.col(url_col)).alias("url"), T.ascii_for_store(F.col(text_col)).alias("contents"), F.lit(self._added).cast("long").alias("added"))
        clean.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """One row an id."""
        return first_rows(self.spark.read.schema(self.SCHEMA).parquet(self.path), "id", ["added", "url", "contents"]).drop("added")

    def get(self, *ids: int) -> DataFrame:
        """The rows of these ids; the filter reaches the scan."""
        found = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("id").isin(*ids))
        return first_rows(found, "id", ["added", "url", "contents"]).drop("added")


def first_rows(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the first by the columns given."""
    rest = [c for c in table.columns if c != key]
    least = F.min_by(F.struct(*rest), F.struct(*order))
    return table.groupBy(key).agg(least.alias("_row")).select(key, "_row.*")


def resolved_names(ids: DataFrame, names: DataFrame, id_col: str = "doc_id", name_col: str = "name") -> DataFrame:
    """ids with their document's name, or NOT_FOUND."""
    return ids.join(first_rows(names.select(id_col, name_col), id_col, [name_col]), id_col, "left").withColumn(name_col, F.coalesce(name_col, F.lit(NOT_FOUND)))


def registered_names(names: DataFrame) -> DataFrame:
    """Of (segment, path, ...) rows the first one of each path, by segment."""
    order = Window.partitionBy("path").orderBy("segment")
    return names.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def repeated_names(names: DataFrame) -> DataFrame:
    """(path, n, segments) of the paths that are there more than once."""
    return names.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("segment")).alias("segments")).where("n > 1")


class NameRegistry:
    """Paths and their names in a folder: a path is registered once, by the first row that has it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._empty = True

    def insert(self, names: DataFrame) -> None:
        """Register those of the rows (segment, path) whose path isn't there yet."""
        rows = registered_names(names.select("segment", "path"))
        (rows if self._empty else new_paths(rows, self.rows())).write.mode("append").parquet(self.path)
        self._empty = False

    def rows(self) -> DataFrame:
        return self.spark.read.schema("segment string, path string").parquet(self.path)

    def get(self, *paths: str) -> DataFrame:
        """The rows of these paths; the filter reaches the scan."""
        return self.rows().where(F.col("path").isin(*paths))


def known_paths(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    return candidates.join(registry.select("path").distinct(), "path", "left_semi")


def new_paths(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    return candidates.join(registry.select("path").distinct(), "path", "left_anti")
