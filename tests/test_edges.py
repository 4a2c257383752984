"""Constant features, single rows, zero vectors, null dimensions, unknown ids."""

import pytest

from reco.operators import features as FE
from reco.operators.similarity import content_similarity
from reco.plans import registry, serve
from reco.plans.registry import Fx
from reco.sources import readers as RD
from tests.conftest import SF_SMALL

CATALOG = ("id long, country string, flavor string, style string, average_rating double, number_of_ratings long, "
           "average_aroma_rating double, average_appearance_rating double, average_taste_rating double, average_body_rating double")


def catalog(spark, n):
    rows = [(i, "A", "x" if i % 2 else None, None, 3.0, 5, 1.0 + i, 2.0, float(i * i), 4.0) for i in range(n)]
    return spark.createDataFrame(rows, CATALOG)


def test_constant_column_has_zero_scores(spark):
    rows = FE.content_features(catalog(spark, 6)).collect()
    assert all(r.z_average_body_rating == 0 and r.z_number_of_ratings == 0 for r in rows)
    assert len({r.z_average_aroma_rating for r in rows}) == 6
    assert content_similarity(catalog(spark, 6), top_k=2).count() == 12


def test_one_row_catalog(spark):
    assert FE.content_features(catalog(spark, 1)).count() == 1
    assert content_similarity(catalog(spark, 1), top_k=2).count() == 0


def test_centred_constant_vector_is_dropped(spark):
    r = spark.createDataFrame([(1, 1, 3.0), (2, 1, 3.0), (1, 2, 1.0), (2, 2, 5.0)], "user_id long, item_id long, rating double")
    got = FE.rating_vectors(r, "item", center=True).collect()
    assert {x.id for x in got} == {2} and sum(x.value ** 2 for x in got) == pytest.approx(1)


def test_unrated_items_and_missing_dimensions(spark):
    beers = spark.createDataFrame([(1, 1, None, 7, 4.0, 2, 1.0, 1.0, 1.0, 1.0), (2, 1, 5, 9, None, 0, None, None, None, None),
                                   (3, 1, 5, None, 2.0, 1, 1.0, 1.0, 1.0, 1.0)],
                                  "id long, brand_id int, flavor_id int, style_id int, average_rating double, number_of_ratings long, "
                                  "average_aroma_rating double, average_appearance_rating double, average_taste_rating double, average_body_rating double")
    brands = spark.createDataFrame([(1, "b", 3)], "id int, name string, origin_id int")
    dims = [spark.createDataFrame([row], "id int, name string") for row in ((3, "land"), (5, "malt"), (7, "ale"))]
    got = {r.id: (r.country, r.flavor, r.style) for r in RD.item_catalog(beers, brands, *dims).collect()}
    assert got == {1: ("land", None, "ale"), 3: ("land", "malt", None)}


def test_unknown_ids_get_the_popular_list(spark):
    rows = registry.QUERIES["q1_recommend_for_users"](spark, SF_SMALL).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.source, set()).add(r.user_id)
    assert kinds["popular"] and all(u >= registry.GUEST_BASE for u in kinds["popular"])
    assert kinds["personal"] and not kinds["personal"] & kinds["popular"]


def test_fallback_of_both_supports(spark):
    reco = spark.createDataFrame([(1, 10, 4.0, 1)], "user_id long, item_id long, pred_rating double, rank int")
    req = spark.createDataFrame([(1,), (2,), (2,), (None,)], "user_id long")
    best = spark.createDataFrame([(7, 5.0, 9, 1), (8, 4.0, 9, 2)], "item_id long, rating double, count long, rank int")
    got = sorted((r.user_id or -1, r.item_id, r.source) for r in serve.recommend_for_users(req, reco, best, 1).collect())
    assert got == [(-1, 7, "popular"), (1, 10, "personal"), (2, 7, "popular")]
    none = best.filter("count > 100")
    assert serve.recommend_for_users(req, reco, none, 5).count() == 1


@pytest.mark.parametrize("name", ["m5_item_knn_recs", "m6_user_knn_mae"])
def test_rating_knn_is_joins_and_aggregates(spark, name):
    """Only the neighbour search runs Python; J7, J8, J9 and A11 do not."""
    plan = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
    assert ("LeftAnti" in plan) == name.endswith("recs")


def test_serving_reads_the_stored_table(spark):
    plan = registry.QUERIES["q1_recommend_for_users"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_no_scratch_folder_without_a_name_on_a_cluster(spark, monkeypatch):
    from reco import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
