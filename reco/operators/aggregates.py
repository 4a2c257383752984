"""Grouped aggregates.

All of these are hash aggregates with map-side partial aggregation, so a hot
key is combined on the map side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_per_key(df: DataFrame, keys: list[str], value_cols: list[str],
                   order_cols: list[str]) -> DataFrame:
    """One row per key, the values of the row that is greatest by
    ``order_cols`` (last write wins, with an explicit order instead of arrival
    order)."""
    v = F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("_v")
    return df.groupBy(*keys).agg(v).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def count_per(df: DataFrame, keys: list[str], alias: str = "n") -> DataFrame:
    """A3 / A5: rows per key (``reduceByKey(add)``)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias(alias))


def most_active(df: DataFrame, key: str = "user_id") -> DataFrame:
    """The key with most rows; smallest key wins a tie.  ``limit(1)`` after
    ``orderBy`` is a distributed take-ordered (partial top-1 per task)."""
    c = count_per(df, [key], "n_ratings")
    return c.orderBy(F.desc("n_ratings"), F.asc(key)).limit(1)


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample standard deviation (ddof=1) of each column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return df.agg(*aggs)


def l2_norms(long_df: DataFrame, key: str, value: str = "value", alias: str = "norm") -> DataFrame:
    """L2 norm per vector in long (key, dim, value) form."""
    return long_df.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias(alias))


def weighted_mean(df: DataFrame, keys: list[str], weight: str, value: str) -> DataFrame:
    """sum(w*r) / sum(|w|) per key, only where the numerator is positive
    (F11: the reference discards non-positive numerators before dividing)."""
    g = df.groupBy(*keys).agg(F.sum(F.col(weight) * F.col(value)).alias("num"),
                              F.sum(F.abs(F.col(weight))).alias("den"))
    return g.filter(F.col("num") > 0).select(*keys, (F.col("num") / F.col("den")).alias("pred"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A19 / U2."""
    return df.select(col).distinct()


def vector_space_shape(long_df: DataFrame, key: str, dim: str) -> DataFrame:
    """Number of vectors and the dimension of the space."""
    return long_df.agg(F.count_distinct(key).cast("bigint").alias("n_vectors"),
                       F.count_distinct(dim).cast("bigint").alias("n_dims"))
