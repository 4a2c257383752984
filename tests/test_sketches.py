"""Distinct counts from sketches, against exact ones."""

from pyspark.sql import functions as F

from reco.operators import sketches as SKE
from tests.conftest import SF_SMALL


def check(df, columns):
    est = {r.column: r.n_estimate for r in SKE.estimates(SKE.distinct_sketches(df, columns)).collect()}
    for c in columns:
        n = df.select(F.count_distinct(c)).first()[0]
        assert abs(est[c] - n) <= max(1, SKE.BOUND * n + 1), (c, est[c], n)


def test_every_table(spark):
    for t, cols in {"lineitem": ["l_orderkey", "l_partkey", "l_quantity"], "orders": ["o_custkey", "o_orderkey"], "customer": None,
                    "documents": ["doc_id", "text"], "events": None, "pages": ["url"]}.items():
        d = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        check(d, cols or d.columns[:3])


def test_large_counts_and_nulls(spark):
    d = spark.range(200_000).select((F.col("id") % 70_001).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    check(d, ["a", "b"])


def test_unions_come_from_the_sketches_alone(spark):
    d = spark.range(50_000).select((F.col("id") % 5).alias("tier"), (F.col("id") % 30_011).alias("x"))
    parts = SKE.distinct_sketches(d, ["x"], ["tier"])
    both = SKE.estimates(SKE.combined(parts.filter("tier < 2"))).first().n_estimate
    n = d.filter("tier < 2").select("x").distinct().count()
    assert abs(both - n) <= SKE.BOUND * n
    whole = SKE.estimates(SKE.combined(parts)).first().n_estimate
    assert whole == SKE.estimates(SKE.distinct_sketches(d, ["x"])).first().n_estimate      # merging loses nothing
    assert parts.select(F.max(F.length("sketch"))).first()[0] < 20_000


def test_empty(spark):
    assert SKE.distinct_sketches(spark.range(0), ["id"]).count() == 0
