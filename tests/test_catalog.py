"""Every catalogue query against its SQL in DuckDB."""

import duckdb
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    key = lambda row: repr([float(f"{x:.6g}") if isinstance(x, float) else x for x in row])
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=key)
    expected = sorted(([r[i] for i in at] for r in want.fetchall()), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert [pytest.approx(x, rel=1e-6, abs=2e-6) if isinstance(x, float) else x for x in b] == a
