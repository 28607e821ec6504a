"""Every report against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from tidewater.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(value):
    return float(f"{value:.9g}") if isinstance(value, float) else str(value) if hasattr(value, "isoformat") else value


def rows_of(rows):
    return sorted(([normal(v) for v in r] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_report_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = rows_of(df.select(*(f"`{n}`" for n in names)).collect())
    if name in catalogue.ORACLE_SQL:
        assert names == sorted(duck.sql(catalogue.ORACLE_SQL[name]).columns)
        assert got == rows_of(duck.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({catalogue.ORACLE_SQL[name]})").fetchall())
    else:
        assert got


def test_every_report_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'risky_positions' in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
