"""Popularity lists and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reco.functions.columns import abs_error, squared_error
from reco.operators.ranking import global_rank, nth_row, top_n


def best_rated(catalog: DataFrame, min_support: int = 0, n: int | None = None) -> DataFrame:
    """M3 (F2 + F3/F4 + O1): items with number_of_ratings > min_support, by
    average rating desc, then id.  Returns (item_id, rating, count, rank).
    With ``n`` only the first n are ranked (distributed take-ordered);
    without, every item gets its global rank."""
    b = (catalog.filter(F.col("number_of_ratings") > F.lit(max(0, min_support)))
         .select(F.col("id").alias("item_id"), F.col("average_rating").alias("rating"),
                 F.col("number_of_ratings").cast("bigint").alias("count")))
    order = [F.col("rating").desc(), F.col("item_id").asc()]
    if n is not None:
        return top_n(b, order, n)
    return global_rank(b, order)


def catalog_baseline_mae(catalog: DataFrame, ratings: DataFrame) -> DataFrame:
    """M1 (J3 + A12): predict every rating with the catalog's average rating;
    MAE over ratings of items present in the catalog."""
    avg = catalog.filter(F.col("number_of_ratings") > 0).select(
        F.col("id").alias("item_id"), F.col("average_rating").alias("pred"))
    r = ratings.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    j = r.join(avg, "item_id")
    return j.agg(F.avg(abs_error("rating", "pred")).alias("mae"),
                 F.count(F.lit(1)).cast("bigint").alias("n_pairs"))


def item_means(ratings: DataFrame) -> DataFrame:
    """A4: mean rating per item (with the count)."""
    return ratings.groupBy("item_id").agg(F.avg("rating").alias("avg_rating"),
                                          F.count(F.lit(1)).cast("bigint").alias("n"))


def item_mean_baseline(fit: DataFrame, test: DataFrame) -> DataFrame:
    """M2 (A4 + J3 + A13): RMSE of predicting each test rating with the item
    mean from ``fit``; items unseen in ``fit`` fall back to the global mean
    of ``fit`` (D12).  Pass all ratings as ``fit`` to reproduce the reference."""
    means = item_means(fit).select("item_id", "avg_rating")
    glob = fit.agg(F.avg("rating")).first()[0]  # one scalar
    j = test.join(means, "item_id", "left")
    p = j.withColumn("pred", F.coalesce(F.col("avg_rating"), F.lit(glob).cast("double")))
    return p.agg(F.sqrt(F.avg(squared_error("rating", "pred"))).alias("rmse"),
                 F.avg(abs_error("rating", "pred")).alias("mae"),
                 F.count(F.lit(1)).cast("bigint").alias("n_pairs"))


def item_counts_and_means(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """M11 (J11 + A3 + A4): count per catalog item including zero, and mean
    (null when unrated).  ``items`` has item_id."""
    s = ratings.groupBy("item_id").agg(F.count(F.lit(1)).cast("bigint").alias("count"),
                                       F.avg("rating").alias("avg_rating"))
    return (items.select("item_id").join(s, "item_id", "left")
            .select("item_id", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "avg_rating"))


def sales_counts(purchases: DataFrame) -> DataFrame:
    """A3 over purchase rows: purchases per item."""
    return purchases.groupBy("item_id").agg(F.count(F.lit(1)).cast("bigint").alias("purchases"))


def best_sellers(purchases: DataFrame, n: int = 10) -> DataFrame:
    """O2: top-n items by purchase count, ties by item id."""
    return top_n(sales_counts(purchases), [F.col("purchases").desc(), F.col("item_id").asc()], n)


def nth_best_seller(purchases: DataFrame, n: int = 101) -> DataFrame:
    """The n-th best seller (count threshold); empty if fewer items."""
    return nth_row(sales_counts(purchases), [F.col("purchases").desc(), F.col("item_id").asc()], n)


def popularity_percent_ranks(purchases: DataFrame, top: int = 100) -> DataFrame:
    """The top items by purchase count mapped to percent ranks
    100*(i-1)/top, i = 1..min(top, n_items) (D16)."""
    t = best_sellers(purchases, top)
    return t.select("item_id", "purchases", "rank",
                    (100.0 * (F.col("rank") - 1) / F.lit(float(top))).alias("pct"))


def popularity_mpr(test: DataFrame, ranks: DataFrame) -> DataFrame:
    """A15 (F9 + A16): MPR of the popularity baseline, restricted to test rows
    whose item is in the ranked top list: sum(r * pct) / sum(r)."""
    # ranks is a top-n list: its size is bounded by n, so broadcasting it is safe
    j = test.join(F.broadcast(ranks.select("item_id", "pct")), "item_id")
    return j.agg((F.sum(F.col("rating") * F.col("pct")) / F.sum("rating")).alias("mpr"),
                 F.sum("rating").alias("sum_rating"), F.count(F.lit(1)).cast("bigint").alias("n_rows"))
