"""Registered queries against their SQL on the smallest tables; submission rules."""

import math

import duckdb
import pytest

from larkmill.plans import workload

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_against_sql(spark, sf, duck, name):
    got = workload.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=repr)
    ran = duck.execute(workload.ORACLES[name])
    names = [x[0] for x in ran.description]
    want = sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in ran.fetchall()), key=repr)
    assert sorted(names) == columns and rows == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("True True"), out.stderr[-500:]


def test_submission(spark, sf):
    out = workload.QUERIES["e04_submission"](spark, sf)
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert out.count() == n == out.select("sample_id").distinct().count() and out.where("price < 0.01 OR price IS NULL").count() == 0
