"""Every query against its SQL on the smallest tables, and what is left without the optional part."""

from __future__ import annotations

import datetime
import math
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from quillspark import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_query_without_sql_runs(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_names_every_query(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    if (ROOT / "quillspark" / "llm").exists():
        assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in entry.queries()} and "pipeline" in entry.queries()
    assert entry.entry(spark).count() == 20


def test_entry_imports_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_term_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
