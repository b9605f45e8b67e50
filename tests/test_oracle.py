"""Every registered query equals its DuckDB oracle on sf0.001 (row count, columns, values)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, canon, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[name])
    o_cols, o_rows = canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert digest(s_rows) == digest(o_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "point_count" in df.columns
