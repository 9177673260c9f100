"""The queries that have SQL against DuckDB, on small tables with the awkward rows of TESTDATA."""

import os

import duckdb
import pytest

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in cur.description)
    want = sorted(tuple(dict(zip([c[0] for c in cur.description], r, strict=True))[c] for c in columns) for r in cur.fetchall())
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want
