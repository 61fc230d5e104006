"""Queries against their SQL in DuckDB at the smallest scale."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from riskweave.plans.registry import ORACLES, QUERIES

WHERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(WHERE).exists(), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return str(v)
    return float(f"{float(v):.8g}") + 0.0 if not math.isnan(float(v)) else None


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, WHERE)
    got = df.collect()
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: repr(row)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got), key=key) == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_llm_part(tmp_path, pipeline):
    """In a copy of the repository without the training-data operators, with and without the pipeline's file."""
    here = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    assert not (copy / "riskweave" / "llm").exists() and (copy / "corpus_pipeline.py").exists() == pipeline
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); assert not [x for x in q if x == 'pipeline' or x.startswith('op1')]; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(QUERIES)
