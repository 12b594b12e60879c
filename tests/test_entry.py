"""The driver's contract, with or without the part that may be left out."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog import queries

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_it_imports_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and 'read_or_items' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


@pytest.mark.skipif(not DATA.exists(), reason="needs the synthetic tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    df = queries.QUERIES[name](spark, str(DATA))
    expected = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = sorted(df.columns)
    at = [expected.columns.index(c) for c in order]
    key = lambda t: tuple(map(str, t))
    assert sorted((tuple(r) for r in df.select(*order).collect()), key=key) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=key)
