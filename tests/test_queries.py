"""Every query with SQL gives DuckDB's rows on the smallest test data; the others run."""

import math
import os

import pytest

from cairn.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def rows(df):
    def cell(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return "%.6g" % (float(v) + 0.0)
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple("-" if (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>") else cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_import_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 200"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
