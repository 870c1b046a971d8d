from __future__ import annotations

from pathlib import Path

import pytest

from quillspark import storage


def test_rows_held_on_the_driver(spark):
    rows = [("a", 1, 2**60, 1.5, None), ("it's", -1, 0, -0.0, "x")]
    df = storage.local_rows(spark, rows, "s string, i int, l bigint, d double, n string")
    assert [tuple(r) for r in df.collect()] == rows
    assert storage.local_rows(spark, [], "s string").count() == 0
    few, found = storage.held(df)
    assert [tuple(r) for r in found] == [tuple(r) for r in few.collect()] == rows
    many = spark.range(storage.HELD_ROWS + 1)
    same, none = storage.held(many)
    assert none is None and same is many


def test_written_tables_lie_in_the_named_folder(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "CAST(NULL AS STRING) AS nothing")
    again = storage.written(df, "numbers")
    assert again.dtypes == df.dtypes and again.count() == 10
    assert all(f.startswith(storage.shared_folder(spark).removeprefix("file://").removeprefix("file:")) for f in (x.removeprefix("file://") for x in again.inputFiles()))


def test_only_small_tables_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    big = spark.range(100)
    assert "broadcast" in plan(big.join(storage.small(spark.range(5)), "id")).lower()
    assert "strategy=broadcast" not in plan(big.join(storage.small(spark.range(5), 4), "id"))


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())


def test_clear_deletes_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(storage, "_MADE", [])
    kept = storage.written(spark.range(5).toDF("x"), "kept")
    path = Path(storage._MADE[0].removeprefix("file://"))
    assert kept.count() == 5 and path.exists()
    storage.clear(spark)
    assert not path.exists() and not storage._MADE


def test_small_goes_by_rows_and_bytes(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) AS t")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(storage.small(df)) and not hinted(storage.small(df, rows=9)) and not hinted(storage.small(df, most_bytes=999)) and hinted(storage.small(df.select("id"), most_bytes=0))
