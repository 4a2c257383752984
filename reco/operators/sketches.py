"""Approximate distinct counts from stored, mergeable sketches.

A HyperLogLog sketch of each group is built once, in the map tasks, and stored
as a few kilobytes.  Counts of any union of groups follow from the sketches
alone, without reading the rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LG_K = 14          # 2^14 registers
#: Three standard errors of a sketch with that many registers.
BOUND = 3 * 1.04 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``by..., column, sketch`` for each column, over each group of ``by``."""
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_v")
    return (df.select(*(by or []), value).select(*(by or []), "_v.column", "_v.value").filter(F.col("value").isNotNull())
            .groupBy(*(by or []), "column").agg(F.hll_sketch_agg("value", F.lit(LG_K)).alias("sketch")))


def combined(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of the unions of the groups that agree on ``by`` and the column."""
    return sketches.groupBy(*(by or []), "column").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("n_estimate", F.hll_sketch_estimate("sketch")).drop("sketch")


def within_bound(estimate, exact):
    """Whether an estimate is as near as the sketch promises."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), F.ceil(exact * BOUND).cast("double"))
