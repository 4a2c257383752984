"""Model operators: planted low-rank recovery, LSH recall, Newton optimality."""

import numpy as np
from pyspark.sql import functions as F

from reco.operators import factorization as FA
from reco.operators.similarity import ann_neighbors, vector_similarity


def test_als_recovers_planted_rank2(spark):
    rng = np.random.default_rng(0)
    A, B = rng.uniform(0.5, 1.5, size=(30, 2)), rng.uniform(0.5, 1.5, size=(20, 2))
    M = A @ B.T
    rows = [(u, i, float(M[u, i])) for u in range(30) for i in range(20)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    m = FA.fit_explicit(df, rank=2, max_iter=30, reg=0.001, seed=1)
    e = FA.evaluate_explicit(m, df).first()
    base = np.sqrt(((M - M.mean(axis=0)) ** 2).mean())
    assert e.rmse < 0.1 * base
    # fixed seed -> identical output
    m2 = FA.fit_explicit(df, rank=2, max_iter=30, reg=0.001, seed=1)
    assert abs(FA.evaluate_explicit(m2, df).first().rmse - e.rmse) < 1e-9


def test_top_unseen_excludes_rated(spark):
    rows = [(u, i, float(1 + (u * i) % 5)) for u in range(8) for i in range(10) if (u + i) % 3]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    titles = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "item_id int, title string")
    m = FA.fit_explicit(df, rank=3, max_iter=5, reg=0.1, seed=1)
    top = FA.top_unseen(m, df, titles, n=3, min_count=1).collect()
    rated = {(u, i) for u, i, _ in rows}
    assert top and all((r.user_id, r.item_id) not in rated for r in top)
    assert all(r["count"] > 1 for r in top)


def test_lsh_recall_against_exact(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(200, 16))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    exact = vector_similarity(df, top_k=10).toPandas()
    approx = ann_neighbors(df, k=10).toPandas()
    hit = 0
    for i in range(200):
        hit += len(set(exact[exact.id1 == i].id2) & set(approx[approx.id1 == i].id2))
    assert hit / 2000 >= 0.8


def test_lsh_on_unclustered_vectors(spark):
    """The registered parameters on the table's vectors, which have no
    clusters: few candidates are spared there, but recall holds."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from reco.operators.similarity import lsh_buckets
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    exact, approx = vector_similarity(v, top_k=10), ann_neighbors(v, k=10)
    n = v.count()
    hit = exact.join(approx, ["id1", "id2"]).count() / exact.count()
    h = v.select(array_to_vector("embedding").alias("_u"))
    h = BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", numHashTables=48, bucketLength=2.0, seed=0).fit(h).transform(h)
    sizes = [r["count"] for r in lsh_buckets(h, 12, 4).groupBy("_bucket").count().collect()]
    compared = sum(s * s for s in sizes) / n ** 2      # over all tables, repeats counted
    assert hit >= 0.75 and compared < 1.0, (hit, compared)
    assert max(sizes) < 0.25 * n


def test_ann_recall_of_the_registered_index(spark):
    """Recall@10 against brute force of the registered parameters on the given
    vectors, and the share of all pairs that they compare."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from reco.operators.similarity import ANN_PLANES, ANN_TABLES, lsh_buckets
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    exact = vector_similarity(v, top_k=10)
    assert exact.join(ann_neighbors(v, k=10), ["id1", "id2"]).count() >= 0.9 * exact.count()
    h = v.select("vec_id", array_to_vector("embedding").alias("_u"))
    h = BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", numHashTables=ANN_TABLES * ANN_PLANES,
                                    bucketLength=2.0, seed=0).fit(h).transform(h)
    rows = lsh_buckets(h, ANN_TABLES, ANN_PLANES).select("vec_id", "_bucket").toPandas()
    at = {b: i for i, b in enumerate(rows["vec_id"].unique())}
    met = np.zeros((len(at), len(at)), bool)
    for ids in rows.groupby("_bucket")["vec_id"]:
        i = [at[x] for x in ids[1]]
        met[np.ix_(i, i)] = True
    print("candidate share", met.mean())
    assert met.mean() < 0.65


def test_distance_to_item_matches_engine(spark):
    """E9 distance column equals the K1 engine's distance for the same pair."""
    from reco.operators import features as FE
    from reco.operators.similarity import content_similarity
    from reco.plans.registry import Fx
    from tests.conftest import SF_SMALL
    f = Fx(spark, SF_SMALL)
    ref = f.catalog.orderBy("id").first()["id"]
    d = {r.id: r.distance for r in FE.distance_to_item(f.catalog, int(ref)).collect()}
    sim = content_similarity(f.catalog, top_k=None).filter(f"item1 = {ref}").collect()
    assert sim and all(abs(d[r.item2] - r.score) < 1e-9 for r in sim)
    assert abs(d[ref]) < 1e-9


def test_splits_come_from_one_pass_over_the_lines(spark, tmp_path):
    """Train, test and validation read the worked-out pairs, not the lines again."""
    from reco.plans import models
    from reco.plans.registry import Fx
    spark.createDataFrame([(o, p, 1, 10.0 * (1 + (o + p) % 5)) for o in range(20) for p in range(5)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    (spark.range(20).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "timestamp '1999-01-01' AS o_orderdate")
     .write.parquet(f"{tmp_path}/orders.parquet"))
    f = Fx(spark, str(tmp_path))
    explicit, implicit = models._explicit_split(f), models._implicit_splits(f)
    for d in (*explicit, *implicit):
        assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
    assert sum(d.count() for d in explicit) == sum(d.count() for d in implicit) == 35
