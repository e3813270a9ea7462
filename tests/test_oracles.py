"""Every registered query against its DuckDB oracle on the smallest fixture
(the same check the driver runs at sf0.01)."""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import rows_of  # noqa: E402
from tallyframe.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLES[key])
    b, bc = rows_of([d[0] for d in res.description], res.fetchall())
    assert ac == bc
    assert Counter(a) == Counter(b)
