"""Property checks from SURVEY §5 on random small inputs."""

import numpy as np
from hypothesis import given, settings, strategies as st, HealthCheck

from reco.operators import blocks
from reco.operators import neighborhood as NB
from reco.operators.evaluate import accuracy


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(min_value=0, max_value=10_000))
def test_cosine_symmetric_and_bounded(spark, seed):
    rng = np.random.default_rng(seed)
    cells = {(int(e), int(d)): float(rng.integers(1, 6)) for e, d in zip(rng.integers(0, 15, 80), rng.integers(0, 10, 80))}
    df = spark.createDataFrame([(e, d, v) for (e, d), v in cells.items()], "e long, d long, v double")
    r = blocks.sparse_topk(df, "e", "d", "v", None, block_rows=4).toPandas()
    assert ((r.score <= 1 + 1e-12) & (r.score > 0)).all()
    s = {(a, b): x for a, b, x in zip(r.e1, r.e2, r.score)}
    assert all(abs(s[(b, a)] - x) < 1e-12 for (a, b), x in s.items())
    assert (r.e1 != r.e2).all()


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(min_value=0, max_value=10_000))
def test_knn_predictions_within_contributing_range(spark, seed):
    rng = np.random.default_rng(seed)
    cells = {(int(u), int(i)): float(rng.integers(1, 6)) for u, i in zip(rng.integers(0, 12, 70), rng.integers(0, 10, 70))}
    rows = [(u, i, r) for (u, i), r in cells.items()]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    nb, by = NB.neighbors_for("item", df, k=3, block_rows=4)
    recs = NB.knn_recommendations(nb, df, by, 5).collect()
    rated = {(u, i) for u, i, _ in rows}
    assert all((r.user_id, r.item_id) not in rated for r in recs)
    # cosine weights of positive ratings are >= 0: predictions stay in [1, 5]
    assert all(1 - 1e-9 <= r.pred_rating <= 5 + 1e-9 for r in recs)


def test_pooled_accuracy_equals_plain_accuracy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(u), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for u in rng.integers(0, 9, 200)]
    df = spark.createDataFrame(rows, "user_id long, label int, prediction int")
    pooled = accuracy(df).first().accuracy
    per = {}
    for u, y, p in rows:
        n, c = per.get(u, (0, 0))
        per[u] = (n + 1, c + (y == p))
    manual = sum(c for n, c in per.values()) / sum(n for n, c in per.values())
    assert abs(pooled - manual) < 1e-12
