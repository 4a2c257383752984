"""Ordering, top-k and percent-rank operators.

* ``top_n`` -- global top-n: ``orderBy().limit(n)`` plans as a distributed
  take-ordered (each task keeps n rows), then ranks the n survivors.
* ``top_n_per_group`` -- ``row_number() <= n`` per key; Spark plans a partial
  ``WindowGroupLimit`` before the shuffle, so a hot key sends at most n rows
  per map task.
* ``global_rank`` -- rank of every row in a total order without a
  single-partition window: range-partitioned sort + per-partition offsets.
* ``rank_in_group`` -- 1-based position and group size per key for
  *unbounded* groups (W2 needs every row of a user): the rows are
  range-partitioned on (key, order), so a hot key is spread over many tasks,
  and each row's position is its local position plus the count of the same key
  in earlier partitions (a small per-(partition, key) table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n(df: DataFrame, order: list[Column], n: int, alias: str = "rank") -> DataFrame:
    """The first n rows of a total order, ranked 1..n."""
    head = df.orderBy(*order).limit(n)
    return head.withColumn(alias, F.row_number().over(Window.orderBy(*order)))


def nth_row(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n-th row of a total order (empty if fewer rows, D16)."""
    return top_n(df, order, n, "_pos").filter(F.col("_pos") == n).drop("_pos")


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int | None,
                    alias: str = "rank") -> DataFrame:
    """Per-key ranking, kept to n rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = df.withColumn(alias, F.row_number().over(w))
    return r.filter(F.col(alias) <= n) if n is not None else r


def global_rank(df: DataFrame, order: list[Column], alias: str = "rank") -> DataFrame:
    """1-based rank of every row in a total order (include a unique tie-break
    column in ``order``): ``rank_in_group`` with one constant key, i.e. a
    range-partitioned sort plus per-partition offsets, all JVM-side."""
    r = rank_in_group(df.withColumn("_all", F.lit(0)), "_all", order, alias, "_n")
    return r.drop("_all", "_n")


def rank_in_group(df: DataFrame, key: str, order: list[Column], pos: str = "pos",
                  size: str = "n") -> DataFrame:
    """1-based position of each row within its key in ``order`` plus the key's
    row count, without gathering a key's rows into one task."""
    from reco.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    sorted_ = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    # Materialise the partition tags once: both branches below (local
    # positions and the offset table) must see the same range partitioning,
    # and a recomputation could sample different range bounds.
    x = sorted_.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    # local position within (partition, key); Spark re-hashes on
    # (_pid, key), and each such group is bounded by one range partition.
    wl = Window.partitionBy("_pid", key).orderBy(*order)
    x = x.withColumn("_lpos", F.row_number().over(wl))
    cnt = x.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_c"))
    # offsets: rows of the same key in earlier partitions (one row per
    # (partition, key): bounded by the number of partitions per key)
    wo = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = (cnt.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0)))
              .withColumn(size, F.sum("_c").over(Window.partitionBy(key))))
    j = x.join(off.select("_pid", key, "_off", size), ["_pid", key])
    return j.withColumn(pos, F.col("_lpos") + F.col("_off")).drop("_pid", "_lpos", "_off")
