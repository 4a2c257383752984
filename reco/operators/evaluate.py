"""Held-out evaluation.

Metrics are aggregates over a (user, item, rating, pred) frame.  MPR needs
each row's position among its user's predictions; ``rank_in_group`` computes
it without gathering a user's rows into one task (a user may hold a third of
all rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reco.functions.columns import abs_error, hash_bucket, percent_rank_expr, squared_error
from reco.operators.ranking import rank_in_group


INNER = 1  # salt of splits inside a training set


def hash_split(df: DataFrame, seed: int = 0, train_pct: int = 80, keys=("user_id", "item_id"),
               salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """Deterministic train/test split on the key (same split in SQL).
    Splits of different seeds are independent; a split inside a training set
    takes another ``salt``, so it is independent of the outer one too."""
    b = hash_bucket(list(keys), seed, salt=salt)
    return df.filter(b < train_pct), df.filter(b >= train_pct)


def error_metrics(scored: DataFrame, actual: str = "rating", pred: str = "pred") -> DataFrame:
    """A12 + A13: MAE, RMSE and the number of scored pairs."""
    return scored.agg(F.sqrt(F.avg(squared_error(actual, pred))).alias("rmse"),
                      F.avg(abs_error(actual, pred)).alias("mae"),
                      F.count(F.lit(1)).cast("bigint").alias("n_pairs"))


def percent_ranks(scored: DataFrame, inclusive: bool = False, pred: str = "pred") -> DataFrame:
    """Each row's percent rank among its user's rows, highest
    prediction first, ties by item id."""
    order = [F.col(pred).desc(), F.col("item_id").asc()]
    r = rank_in_group(scored, "user_id", order, "pos", "n_user")
    return r.withColumn("pct", percent_rank_expr("pos", "n_user", inclusive))


def mpr(scored: DataFrame, held_out: DataFrame | None = None, denominator: str = "joined",
        inclusive: bool = False, pred: str = "pred") -> DataFrame:
    """Mean percentage ranking sum(r * pct) / sum(r).

    ``scored`` holds held-out rows that received a prediction.  With
    ``denominator="all"`` the sum of ratings runs over every held-out row,
    cold-start rows included, as in the reference (D14); ``"joined"`` uses the
    scored rows only.  Both counts are reported."""
    p = percent_ranks(scored, inclusive, pred)
    s = p.agg(F.sum(F.col("rating") * F.col("pct")).alias("num"),
              F.sum("rating").alias("den_joined"),
              F.count(F.lit(1)).cast("bigint").alias("n_joined"))
    if held_out is None or denominator == "joined":
        return s.select((F.col("num") / F.col("den_joined")).alias("mpr"), "den_joined", "n_joined")
    h = held_out.agg(F.sum("rating").alias("den_all"), F.count(F.lit(1)).cast("bigint").alias("n_all"))
    # two one-row aggregates side by side (zip of scalars, not a data join)
    row = h.first()
    return s.select((F.col("num") / F.lit(row["den_all"])).alias("mpr"), "den_joined", "n_joined",
                    F.lit(row["den_all"]).alias("den_all"), F.lit(row["n_all"]).cast("bigint").alias("n_all"))


def average_by_point(results: DataFrame, point_cols: list[str], metrics: list[str]) -> DataFrame:
    """Mean of each metric over repeats, per parameter point."""
    return results.groupBy(*point_cols).agg(*[F.avg(m).alias(m) for m in metrics],
                                            F.count(F.lit(1)).cast("bigint").alias("n_runs"))


def best_point(results: DataFrame, metric: str, order_cols: list[str]) -> DataFrame:
    """Arg-min of ``metric``; the first point in ``order_cols`` wins ties."""
    return results.orderBy(F.col(metric).asc(), *[F.col(c).asc() for c in order_cols]).limit(1)


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Pooled accuracy = mean of correct over all test rows (equal to
    sum_u n_u*acc_u / sum_u n_u)."""
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def summarize_runs(results: DataFrame, metric: str) -> DataFrame:
    """Mean and sample std of a metric over repeated runs."""
    return results.agg(F.avg(metric).alias(f"mean_{metric}"), F.stddev_samp(metric).alias(f"std_{metric}"),
                       F.count(F.lit(1)).cast("bigint").alias("n_runs"))
