"""The driver's contract, and all queries with SQL against DuckDB."""

import datetime
import decimal
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = driver.queries()[name](spark, SMALL)
    result = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0 and driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", [n for n in ("guard_pages_jsx", "slice_graph", "cache_lru") if n in driver.queries()])
def test_queries_without_sql_run(spark, name):
    assert driver.queries()[name](spark, SMALL).count() > 0


def test_entry_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.abspath(driver.__file__))
    shutil.copytree(os.path.join(root, "codemosaic"), tmp_path / "codemosaic", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(driver.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'edges_uses' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and e.oracle_sql().keys() <= q.keys()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
