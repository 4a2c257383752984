"""Pivot search against all pairs."""

import numpy as np
import pandas as pd
import pytest

from reco.operators.blocks import dense_topk
from reco.operators.features import CATEGORY_FEATURES, Z_COLS, content_features
from reco.operators.pivots import PivotSearch
from reco.plans.registry import Fx
from tests.conftest import SF_SMALL


def rows_of(df):
    return sorted((r.e1, r["rank"], r.e2, round(r.score, 9)) for r in df.collect())


def clustered(spark, n=900, groups=15, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, groups, n)
    centres = 3 * rng.normal(size=(groups, 4))
    x = centres[at] + 0.1 * rng.normal(size=(n, 4))
    x[:40] = x[0]                                   # a group of equal rows
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n) * 3, **{f"x{i}": x[:, i] for i in range(4)},
                                               "c": np.where(at % 5 == 0, None, (at % 7).astype(str))}))


NUM, CAT = [f"x{i}" for i in range(4)], ["c"]


@pytest.mark.parametrize("options", [{"cell_rows": 40}, {"cell_rows": 300, "chunk_rows": 64}, {"cell_rows": 10_000}])
def test_same_lists_as_all_pairs(spark, options):
    df = clustered(spark)
    assert rows_of(PivotSearch(df, "id", NUM, CAT, 7, **options).top()) == rows_of(dense_topk(df, "id", NUM, CAT, 7))


def test_clusters_spare_most_pairs(spark):
    s = PivotSearch(clustered(spark), "id", NUM, CAT, 7, cell_rows=30)
    assert s.compared() < 0.35 * s.n ** 2
    # copies of a row: as a member, and one for each cell it looks into
    assert s.visits.count() < 8 * s.n


def test_items_of_the_catalog(spark):
    feats = content_features(Fx(spark, SF_SMALL).catalog)
    for k in (10, 500):                              # 500: more than there are items
        a = PivotSearch(feats, "id", Z_COLS, CATEGORY_FEATURES, k, cell_rows=25)
        assert rows_of(a.top()) == rows_of(dense_topk(feats, "id", Z_COLS, CATEGORY_FEATURES, k))
        print(k, a.compared() / a.n ** 2)


def test_few_rows(spark):
    df = clustered(spark).limit(1)
    assert PivotSearch(df, "id", NUM, CAT, 3).top().count() == 0
    assert PivotSearch(df.limit(0), "id", NUM, CAT, 3).top().count() == 0
