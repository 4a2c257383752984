"""Principal components of wide sparse data.

Block power iteration over the long (id, dim, value) table: the centred matrix
is never built, and nothing as long as a row or a column reaches the driver.
An iteration multiplies the block of directions (a row a dimension) by the
matrix and by its transpose, two joins with sums combined in the map tasks; the
mean is taken off by its products.  Only ``block x block`` products come to the
driver, to keep the directions orthonormal and to turn them into components.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from reco.session import app_scratch_dir

SPARE = 6             # directions beyond the components asked for
MAX_ROUNDS, TOL = 200, 1e-10


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{app_scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _gram(df: DataFrame, v: str, b: int) -> np.ndarray:
    """V'V of a block of ``b`` columns held as arrays."""
    at = [(i, j) for i in range(b) for j in range(i, b)]
    row = df.agg(*[F.sum(F.col(v)[i] * F.col(v)[j]) for i, j in at]).first()
    out = np.zeros((b, b))
    for (i, j), x in zip(at, row):
        out[i, j] = out[j, i] = x or 0.0
    return out


def _times(v: Column, m: np.ndarray) -> Column:
    """An array column times a small matrix."""
    return F.array(*[sum((v[i] * float(m[i, j]) for i in range(m.shape[0])), F.lit(0.0)) for j in range(m.shape[1])])


def _sums(df: DataFrame, key: str, b: int) -> DataFrame:
    """Per key: sum of value times the other side's array."""
    return (df.groupBy(key).agg(*[F.sum(F.col("value") * F.col("v")[i]).alias(f"_{i}") for i in range(b)])
            .select(key, F.array(*[f"_{i}" for i in range(b)]).alias("v")))


def principal_components(long: DataFrame, k: int = 2, tol: float = TOL, max_rounds: int = MAX_ROUNDS) -> dict:
    """``long``: (id, dim, value), absent entries zero, a row a pair.

    Returns {"coordinates": (id, v array of k), "directions": (dim, v), "explained":
    shares of the whole variance, "rounds"}.  The sign of a component is such
    that its direction's largest entry (by size, then name) is positive."""
    x = _written(long.select("id", "dim", F.col("value").cast("double").alias("value")), "pca-rows")
    n = x.select("id").distinct().count()
    dims = _written(x.groupBy("dim").agg((F.sum("value") / n).alias("mean"), F.sum(F.col("value") * F.col("value")).alias("sq")), "pca-dims")
    n_dims, total = dims.agg(F.count(F.lit(1)), F.sum(F.col("sq") - F.col("mean") * F.col("mean") * n)).first()
    b = min(k + SPARE, n_dims)

    def project(directions: DataFrame) -> DataFrame:
        """Centred rows times the directions: (id, v)."""
        off = dims.join(directions, "dim").agg(*[F.sum(F.col("mean") * F.col("v")[i]) for i in range(b)]).first()
        got = _sums(x.join(directions, "dim"), "id", b)
        return got.select("id", F.array(*[F.col("v")[i] - float(off[i] or 0.0) for i in range(b)]).alias("v"))

    # first directions: numbers of a hash of the dimension
    q = _written(dims.select("dim", F.array(*[F.pmod(F.xxhash64(F.lit(i), "dim"), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1 for i in range(b)]).alias("v")), "pca-v")
    shares, rounds = np.zeros(k), 0
    while True:
        # orthonormal directions by the block's own products, twice for accuracy
        for _ in range(2):
            w, u = np.linalg.eigh(_gram(q, "v", b))
            keep = w > w.max() * 1e-15
            q = _written(q.select("dim", _times(F.col("v"), u * np.where(keep, 1 / np.sqrt(np.where(keep, w, 1)), 0)).alias("v")), "pca-v")
        y = _written(project(q), "pca-y")
        s, u = np.linalg.eigh(_gram(y, "v", b))
        s, u = s[::-1], u[:, ::-1]
        now = s[:k] / total if total else np.zeros(k)
        done = np.abs(now - shares).max() <= tol * max(now.max(), 1e-300)
        shares, rounds = now, rounds + 1
        if done or rounds >= max_rounds:
            break
        # Xc' Y: rows of Y add up to zero, so the mean takes nothing off
        z = _sums(x.join(y, "id"), "dim", b)
        tot = y.agg(*[F.sum(F.col("v")[i]) for i in range(b)]).first()
        q = _written(z.join(dims.select("dim", "mean"), "dim").select(
            "dim", F.array(*[F.col("v")[i] - F.col("mean") * float(tot[i] or 0.0) for i in range(b)]).alias("v")), "pca-v")
    parts = _written(q.select("dim", _times(F.col("v"), u[:, :k]).alias("v")), "pca-directions")
    signs = []
    for i in range(k):
        top = parts.select("dim", F.col("v")[i].alias("x")).orderBy(F.round(F.abs("x"), 9).desc(), "dim").first()
        signs.append(-1.0 if top and top["x"] < 0 else 1.0)
    flip = np.diag(signs)
    return {"coordinates": y.select("id", _times(F.col("v"), u[:, :k] @ flip).alias("v")),
            "directions": parts.select("dim", _times(F.col("v"), flip).alias("v")), "explained": shares.tolist(), "rounds": rounds}
