"""Every registered catalog query against its SQL on the smallest tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers all queries)
from catalith.plans.catalog_queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
SF = os.environ.get("CATALITH_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    flat = lambda row: tuple(tuple(v) if isinstance(v, list) else v for v in row)
    got = sorted((flat(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((flat(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()), key=repr)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "rank_in_group" in e.queries()


def test_queries_without_the_llm_folder(tmp_path):
    """A copy without ``catalith/llm`` and ``tests/llm`` still gives its own queries, with and without the pipeline file."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    call = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(o) <= set(q))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-B", "-c", call], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
        assert done.returncode == 0, done.stderr
        n, *flags = done.stdout.split()[-4:]
        assert int(n) == len(QUERIES) and flags == ["False", "False", "True"]
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
