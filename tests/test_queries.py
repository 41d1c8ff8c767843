"""Every registered query with SQL gives the rows that DuckDB gives, and nothing depends on the llm folder."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from spanwarden.plans import detection_queries, intelligence_queries, queries, report_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if not isinstance(v, list) and pd.isna(v):
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.SQL:
        want = sql.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
class Gone:
    def find_spec(self, name, *a):
        if name == 'corpus_pipeline' or name.startswith('spanwarden.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()) and len(e.queries()) > 50
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_training_data_operators():
    root = Path(__file__).resolve().parents[1] / "spanwarden"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "spanwarden.llm" not in p.read_text() and "from ..llm" not in p.read_text() and "from .llm" not in p.read_text()
