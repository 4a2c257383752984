"""Splits of different seeds, and inner and outer splits, are independent."""

from pyspark.sql import functions as F

from reco.operators import evaluate as EV
from reco.functions.columns import hash_bucket
from reco.plans.registry import Fx
from tests.conftest import SF_SMALL


def test_repeats_overlap_as_chance_would_have_it(spark):
    r = Fx(spark, SF_SMALL).ratings.select("user_id", "item_id").checkpoint()
    n = r.count()
    held = [EV.hash_split(r, s, 80, salt=EV.INNER)[1] for s in (1, 2, 3)]
    for a in range(3):
        assert abs(held[a].count() / n - 0.20) < 0.02
        for b in range(a):
            both = held[a].join(held[b], ["user_id", "item_id"]).count()
            assert abs(both / n - 0.04) < 0.015


def test_inner_split_of_the_outer_seed(spark):
    r = Fx(spark, SF_SMALL).ratings.select("user_id", "item_id").checkpoint()
    train, _ = EV.hash_split(r, 42, 80)
    n = train.count()
    for seed in (41, 42, 43):
        assert abs(EV.hash_split(train, seed, 80, salt=EV.INNER)[1].count() / n - 0.20) < 0.02


def test_buckets_are_even_and_take_any_integer(spark):
    d = spark.range(100_000).select(F.col("id").alias("user_id"), (F.col("id") * 7 - 350_000).alias("item_id"))
    counts = [r["count"] for r in d.groupBy(hash_bucket(["user_id", "item_id"], 5).alias("b")).count().collect()]
    assert len(counts) == 100 and 800 < min(counts) and max(counts) < 1200
    huge = spark.createDataFrame([(2**62, -2**62), (-1, 0)], "user_id long, item_id long")
    assert all(0 <= r.b < 100 for r in huge.select(hash_bucket(["user_id", "item_id"], 0).alias("b")).collect())
