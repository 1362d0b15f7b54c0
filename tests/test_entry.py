"""The entry points with and without the training-data subpackage, and every query against its SQL twin."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quern.plans import catalog

ROOT, SF = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_subpackage(tmp_path, pipeline):
    """Queries of the rest are there where the subpackage is gone, whether the pipeline's file is or not."""
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert not done.returncode, done.stderr


def test_queries_and_twins_have_the_same_names():
    queries, twins = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(twins) <= set(queries) and set(catalog.QUERIES) <= set(queries)


def _plain(v):
    return v if v is None or isinstance(v, bool) else round(float(v), 5) if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)


def test_queries_agree_with_sql(spark):
    con, wrong = duckdb.connect(), []
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in catalog.ORACLES.items():
        got, want = catalog.QUERIES[name](spark, SF), con.sql(sql)
        columns = sorted(got.columns)
        a = sorted(str([_plain(r[c]) for c in columns]) for r in got.collect())
        b = sorted(str([_plain(v) for v in r]) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()) if columns == sorted(want.columns) else None
        if a != b:
            wrong.append(name)
    assert not wrong
