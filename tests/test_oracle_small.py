"""Registered queries vs their DuckDB twins on the smallest fixture."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from reco.tables import TABLE_NAMES
from tests.conftest import SF_SMALL

def _canon(df):
    def n(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    cols = sorted(df.columns)
    return sorted((tuple(n(r[c]) for c in cols) for r in df.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    o = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert _canon(s) == _canon(o)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["item1", "item2", "score", "rank"]
