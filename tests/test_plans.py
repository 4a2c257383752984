"""Plan guards: no cross joins anywhere in the relational queries; pruning and
pushdown reach the scans."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_cross_join(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert not any(f in p for f in FORBIDDEN), name


def test_scans_are_pruned_and_filtered(spark):
    from reco.plans.registry import Fx
    f = Fx(spark, SF_SMALL)
    p = f.ratings._jdf.queryExecution().executedPlan().toString()
    li = [line for line in p.splitlines() if "FileScan parquet" in line and "l_orderkey" in line][0]
    for unused in ("l_extendedprice", "l_discount", "l_shipdate", "l_returnflag", "l_comment"):
        assert unused not in li  # column pruning reached the lineitem scan
    c = f.catalog._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in c  # only the columns that the statistics need
