"""Every query that has SQL equals it on the smallest tables."""

import decimal
import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from skirmish.plans import registry

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(plain, r)) for r in zip(*[table.column(n).to_pylist() for n in names]))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    assert rows(registry.QUERIES[name](spark, sf).toArrow()) == rows(con.sql(registry.ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    df = registry.flagship(spark, sf)
    assert df.count() > 0 and "identity_status" in df.columns


def test_entry_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "skirmish"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
