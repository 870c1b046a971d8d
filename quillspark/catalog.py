"""All queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.queries import lifecycle, retrieval, stores

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**retrieval.QUERIES, **stores.QUERIES, **lifecycle.QUERIES}
ORACLES: dict[str, str] = {**retrieval.ORACLES, **stores.ORACLES, **lifecycle.ORACLES}
