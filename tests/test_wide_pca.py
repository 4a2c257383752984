"""Block power iteration against MLlib and a dense decomposition."""

import numpy as np
from pyspark.sql import functions as F

from reco.operators import features as FE
from reco.operators import wide_pca as WP
from reco.plans.registry import Fx
from tests.conftest import SF_SMALL


def dense(rows, n, d):
    x = np.zeros((n, d))
    for i, j, v in rows:
        x[i, j] = v
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    return c, s ** 2 / (s ** 2).sum(), vt


def test_against_a_dense_decomposition(spark):
    rng = np.random.default_rng(2)
    n, d = 60, 12
    rows = [(i, j, float(rng.normal() * (12 - j) ** 1.5 + j)) for i in range(n) for j in range(d) if rng.random() < 0.7 or j == 0]
    got = WP.principal_components(spark.createDataFrame(rows, "id long, dim long, value double"), 3)
    c, shares, vt = dense(rows, n, d)
    assert np.abs(np.array(got["explained"]) - shares[:3]).max() < 1e-6
    v = np.zeros((d, 3))
    for r in got["directions"].collect():
        v[r.dim] = r.v
    assert np.abs(np.abs((vt[:3] @ v)) - np.eye(3)).max() < 1e-3
    y = {r.id: np.array(r.v) for r in got["coordinates"].collect()}
    assert max(np.abs(y[i] - c[i] @ v).max() for i in range(n)) < 1e-6 * np.abs(c).max()


def test_explained_variance_equals_mllib_s(spark):
    f = Fx(spark, SF_SMALL)
    c = FE.fill_missing(FE.drop_for_pca(f.catalog))
    num = c.select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).cast("double").alias("value")) for x in FE.NUMERIC_FEATURES])).alias("_f"))
    long = num.select("id", "_f.dim", "_f.value").unionByName(FE.one_hot_long(c, "id", FE.CATEGORY_FEATURES))
    got = WP.principal_components(long, 2)
    coords, explained = FE.pca_coordinates(f.catalog, 2)
    assert np.abs(np.array(got["explained"]) - np.array(explained)).max() < 1e-6
    y = {r.id: r.v for r in got["coordinates"].collect()}
    pairs = np.array([(*y[r.id], r.pc1, r.pc2) for r in coords.collect()])
    for i in (0, 1):
        assert min(np.abs(pairs[:, i] - pairs[:, 2 + i]).max(), np.abs(pairs[:, i] + pairs[:, 2 + i]).max()) < 1e-3 * np.abs(pairs[:, 2 + i]).max()


def test_a_hundred_thousand_categories(spark):
    """Two planted directions among 100,000 dimensions; no square matrix of them is ever made."""
    n = 100_000
    one = spark.range(n).select("id", F.concat(F.lit("c"), "id").alias("dim"), F.lit(1.0).alias("value"))
    planted = spark.range(n).select("id", F.lit("x").alias("dim"), (F.col("id") % 100).cast("double").alias("value")).unionByName(
        spark.range(n).select("id", F.lit("y").alias("dim"), ((F.col("id") * 7919) % 40).cast("double").alias("value")))
    got = WP.principal_components(one.unionByName(planted), 2, tol=1e-7)
    i = np.arange(n)
    cov = np.cov(np.stack([i % 100, (i * 7919) % 40]).astype(float))
    want = np.sort(np.linalg.eigvalsh(cov))[::-1] * (n - 1) / (np.trace(cov) * (n - 1) + n - 1)
    assert np.abs(np.array(got["explained"]) - want).max() < 1e-4 and got["rounds"] < 15
