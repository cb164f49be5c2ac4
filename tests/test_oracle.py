"""Each registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from semcodec.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(frame: pd.DataFrame) -> list:
    def plain(v):
        return None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else v

    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    found, expected = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
