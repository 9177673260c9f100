"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans.catalog import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    if isinstance(x, dict):
        return str({k: cell(v) for k, v in x.items()})
    if hasattr(x, "asDict"):
        return str({k: cell(v) for k, v in x.asDict().items()})
    try:
        return f"{float(x) + 0.0:.9g}"
    except (TypeError, ValueError):
        return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(cell(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        assert got[1]
        return
    cur = db.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
