"""Exact nearest content vectors by pivots.

Rows are cells of their nearest pivot (rows chosen by a hash of the id).  First
every row finds its k best inside its cell; the k-th of them bounds what is
still worth looking for.  On unit vectors the distance ``2(1 - cos)`` is the
square of a metric, so a row looks into another cell only if its distance to
that cell's pivot, less the cell's radius, doesn't exceed its bound: all other
cells can't hold a better row.  A row is copied once for each cell that it looks
into, and once as a member of its own.  Cells and their visitors are cut into
chunks of bounded size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from reco.operators.blocks import _final_topk, _local_topk
from reco.session import app_scratch_dir

CELL_ROWS, MAX_PIVOTS = 512, 2048
CHUNK_ROWS = 2048
DIGITS, SLACK = 9, 2e-9      # scores rank rounded: what rounds alike must be seen


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{app_scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scores(a: pd.DataFrame, b: pd.DataFrame, num_cols: list[str], cat_cols: list[str]) -> np.ndarray:
    """``2(1 - cos)`` of the rows of two frames; one-hot categories by code."""
    xa, xb = a[num_cols].to_numpy("float64"), b[num_cols].to_numpy("float64")
    dot, na, nb = xa @ xb.T, (xa * xa).sum(axis=1), (xb * xb).sum(axis=1)
    for c in cat_cols:
        codes, _ = pd.factorize(pd.concat([a[c], b[c]], ignore_index=True))
        ca, cb = codes[:len(a)], codes[len(a):]
        dot = dot + ((ca[:, None] == cb[None, :]) & (ca >= 0)[:, None])
        na, nb = na + (ca >= 0), nb + (cb >= 0)
    return 2.0 * (1.0 - dot / (np.sqrt(na)[:, None] * np.sqrt(nb)[None, :]))


class PivotSearch:
    """Cells, visits and lists of the k best of every row."""

    def __init__(self, df: DataFrame, id_col: str, num_cols: list[str], cat_cols: list[str], k: int,
                 cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, chunk_rows: int = CHUNK_ROWS):
        self.k, self.num, self.cat, self.chunk_rows = k, num_cols, cat_cols, chunk_rows
        self.cols = ["_id", *num_cols, *cat_cols]
        norm = sum((F.col(c) * F.col(c) for c in num_cols), F.lit(0.0)) + sum((F.col(c).isNotNull().cast("int") for c in cat_cols), F.lit(0))
        base = _written(df.select(F.col(id_col).cast("long").alias("_id"), *[F.col(c).cast("double").alias(c) for c in num_cols],
                                  *[F.col(c).cast("string").alias(c) for c in cat_cols]).filter(norm > 0), "pivot-rows")
        self.n = base.count()
        count = max(1, min(max_pivots, -(-self.n // cell_rows)))
        pivots = base.orderBy(F.xxhash64("_id"), "_id").limit(count).toPandas()      # at most max_pivots rows
        num, cat = num_cols, cat_cols

        def assign(frames):
            for f in frames:
                if len(f):
                    d = np.sqrt(np.maximum(0.0, scores(f, pivots, num, cat)))
                    f["_cell"], f["_d"] = d.argmin(axis=1).astype("int32"), d.min(axis=1)
                    yield f

        ddl = ", ".join(["_id long", *[f"`{c}` double" for c in num_cols], *[f"`{c}` string" for c in cat_cols]])
        self.rows = _written(base.mapInPandas(assign, f"{ddl}, _cell int, _d double"), "pivot-cells")
        cells = self.rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("r")).collect()    # a row a pivot
        self.sizes = {c["_cell"]: c["n"] for c in cells}
        radius = np.full(count, -np.inf)
        for c in cells:
            radius[c["_cell"]] = c["r"]
        self.own = _written(self._compare(self.rows.select("_id", "_cell")), "pivot-lists")
        w = Window.partitionBy("e1").orderBy("_key", "e2")
        bound = self.own.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k).select(F.col("e1").alias("_id"), F.col("score").alias("_bound"))

        def visit(frames):
            for f in frames:
                if len(f):
                    d = np.sqrt(np.maximum(0.0, scores(f, pivots, num, cat)))
                    far = np.maximum(0.0, d - radius[None, :]) ** 2
                    look = (far <= f["_bound"].fillna(np.inf).to_numpy()[:, None] + SLACK) & np.isfinite(radius)[None, :]
                    look[np.arange(len(f)), f["_cell"].to_numpy()] = False
                    i, c = np.nonzero(look)
                    yield pd.DataFrame({"_id": f["_id"].to_numpy()[i], "_cell": c.astype("int32")})

        self.visits = _written(self.rows.join(bound, "_id", "left").mapInPandas(visit, "_id long, _cell int"), "pivot-visits")

    def _compare(self, queries: DataFrame) -> DataFrame:
        """Local k best of each query (_id, _cell) among the members of the cell."""
        asked = {r["_cell"]: r["n"] for r in queries.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        spark = queries.sparkSession
        plan = [(c, -(-self.sizes[c] // self.chunk_rows), -(-n // self.chunk_rows)) for c, n in asked.items()]
        plan = spark.createDataFrame(plan, "_cell int, _mc int, _qc int")              # a row a pivot
        members = (self.rows.select(*self.cols, "_cell").join(plan, "_cell").withColumn("_m", F.pmod(F.xxhash64("_id"), F.col("_mc")).cast("int"))
                   .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qc") - 1))).withColumn("_side", F.lit(0)))
        asks = (queries.join(self.rows.select(*self.cols), "_id").join(plan, "_cell")
                .withColumn("_q", F.pmod(F.xxhash64("_id"), F.col("_qc")).cast("int"))
                .withColumn("_m", F.explode(F.sequence(F.lit(0), F.col("_mc") - 1))).withColumn("_side", F.lit(1)))
        cols = [*self.cols, "_cell", "_m", "_q", "_side"]
        k, num, cat = self.k, self.num, self.cat

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            a = pdf[pdf["_side"] == 1].sort_values("_id", kind="stable")
            b = pdf[pdf["_side"] == 0].sort_values("_id", kind="stable")
            raw = scores(a, b, num, cat)
            return _local_topk(np.round(raw, DIGITS), raw, a["_id"].to_numpy("int64"), b["_id"].to_numpy("int64"), k, True)

        return (members.select(*cols).unionByName(asks.select(*cols)).groupBy("_cell", "_m", "_q")
                .applyInPandas(best, "e1 long, e2 long, score double, _key double"))

    def compared(self) -> int:
        """Pairs scored: each query times the members of each cell it looks into."""
        visits = {r["_cell"]: r["count"] for r in self.visits.groupBy("_cell").count().collect()}
        return sum((visits.get(c, 0) + n) * n for c, n in self.sizes.items())

    def top(self) -> DataFrame:
        """``e1, e2, score, rank``."""
        lists = self.own
        if self.visits.limit(1).count():
            lists = lists.unionByName(self._compare(self.visits))
        return _final_topk(lists, self.k)
