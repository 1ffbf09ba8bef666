"""Every registered query with a DuckDB twin must give the same rows, columns and
values on the smallest scale factor (the driver runs the same check at sf0.01)."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 100


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = con.sql(ORACLE[name])
    d_rows = rows_of(rel.columns, rel.fetchall())
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["brand", "overall_score", "rating", "review_count"]
    assert df.count() >= 0
