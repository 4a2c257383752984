"""Registered queries with exact SQL twins for steps that follow a fitted model
or an iteration, on given numbers, and queries of the published tables, the
sketches, the per-user trees and the wide components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reco.fixtures import cte
from reco.functions import columns as X
from reco.operators import classify as CL
from reco.operators import evaluate as EV
from reco.operators import factorization as FA
from reco.operators import features as FE
from reco.operators import sketches as SKE
from reco.operators import user_logistic as UL
from reco.operators import user_trees as UT
from reco.operators import wide_pca as WP
from reco.operators.aggregates import most_active
from reco.operators.similarity import content_similarity
from reco.plans import registry as R
from reco.plans import serve
from reco.plans.registry import BAND_HI, BAND_LO, GIVEN, Fx, _bucket, _content_ctes, _given, _given_sql, query, scratch_path
from reco.sources import published as PB

RUNS = [0, 1, 2, 3, 4]
FACTORS = 3


# ---------------------------------------------------------------------------
# scores and metrics of given factors

def _factors(f: Fx, col: str, seed: int):
    d = f.ratings_once.select(F.col(col).alias("id")).distinct()
    if col == "item_id":
        d = d.filter(F.col("id") % 7 != 0)      # items that no fit has seen
    return d.select("id", F.array(*[_given(["id"], seed + k) for k in range(FACTORS)]).alias("v"))


def _scored(f: Fx):
    return FA.score_pairs_by_factors(_factors(f, "user_id", 40), _factors(f, "item_id", 50), f.ratings_once.select("user_id", "item_id", "rating"))


_SCORED_SQL = [("sc", "SELECT user_id, item_id, rating, "
                + " + ".join(f"{_given_sql(40 + k, 'user_id')} * {_given_sql(50 + k, 'item_id')}" for k in range(FACTORS))
                + " AS pred FROM ratings WHERE item_id % 7 <> 0")]
_MPR_SQL = "100.0*(row_number() OVER (PARTITION BY {g}user_id ORDER BY pred DESC, item_id) - 1) / count(*) OVER (PARTITION BY {g}user_id)"


@query("m9_scores_given_factors", cte("ratings", extra=_SCORED_SQL) + "SELECT user_id, item_id, rating, round(pred, 6) AS pred FROM sc")
def _m9(f: Fx):
    """M9 + J4: predictions of rated pairs from given factors; items without a
    factor are dropped."""
    return _scored(f).select("user_id", "item_id", "rating", "pred")


@query("m14_metrics_given_factors", cte("ratings", extra=_SCORED_SQL)
       + "SELECT round(sqrt(avg((rating - pred)*(rating - pred))), 6) AS rmse, round(avg(abs(rating - pred)), 6) AS mae, count(*) AS n_pairs FROM sc")
def _m14g(f: Fx):
    """M14 (explicit) + A12 + A13 on given factors."""
    return EV.error_metrics(_scored(f))


@query("m8_mpr_given_factors", cte("ratings", extra=_SCORED_SQL + [("pr", f"SELECT *, {_MPR_SQL.format(g='')} AS pct FROM sc")])
       + "SELECT round(sum(rating*pct)/(SELECT sum(rating) FROM ratings), 6) AS mpr, round(sum(rating), 6) AS den_joined, count(*) AS n_joined, "
         "round((SELECT sum(rating) FROM ratings), 6) AS den_all, (SELECT count(*) FROM ratings) AS n_all FROM pr")
def _m8g(f: Fx):
    """M8 + M14 (implicit) + A14: MPR of given factors, cold items in the denominator."""
    return EV.mpr(_scored(f), held_out=f.ratings_once, denominator="all")


_POINTS = [0.5, 1.0, 5.0]


@query("m13_grid_given_scores", cte("ratings", extra=[
    ("sc", " UNION ALL ".join(f"SELECT {a} AS alpha, user_id, item_id, rating, {_given_sql(60 + i, 'user_id', 'item_id')} AS pred FROM ratings"
                              for i, a in enumerate(_POINTS))),
    ("pr", f"SELECT *, {_MPR_SQL.format(g='alpha, ')} AS pct FROM sc"),
    ("av", "SELECT alpha, sum(rating*pct)/sum(rating) AS mpr, count(*) AS n_joined FROM pr GROUP BY alpha"),
    ("bp", "SELECT alpha FROM av ORDER BY mpr, alpha LIMIT 1")])
    + "SELECT CAST(av.alpha AS DOUBLE) AS alpha, round(av.mpr, 6) AS mpr, av.n_joined, av.alpha = bp.alpha AS best FROM av, bp")
def _m13g(f: Fx):
    """M13 + A14 + A22: MPR of given scores at each point of a grid, best flagged."""
    res = None
    for i, a in enumerate(_POINTS):
        s = f.ratings_once.select("user_id", "item_id", "rating", _given(["user_id", "item_id"], 60 + i).alias("pred"))
        r = EV.mpr(s).select(F.lit(float(a)).alias("alpha"), "mpr", "n_joined")
        res = r if res is None else res.unionByName(r)
    best = EV.best_point(res, "mpr", ["alpha"]).select("alpha", F.lit(True).alias("best"))
    return res.join(best, "alpha", "left").withColumn("best", F.coalesce("best", F.lit(False)))


@query("m19_summary_given_runs", cte("ratings", extra=[("ru", " UNION ALL ".join(
    f"SELECT {s} AS seed, avg(rating) AS metric FROM ratings WHERE {_bucket(s)} >= 80" for s in RUNS))])
    + "SELECT round(avg(metric), 6) AS mean_metric, round(stddev_samp(metric), 6) AS std_metric, count(*) AS n_runs FROM ru")
def _m19g(f: Fx):
    """A metric of five independent splits, mean and deviation."""
    def run(seed: int) -> float:
        return EV.hash_split(f.ratings_once, seed, 80)[1].agg(F.avg("rating")).first()[0]
    return EV.summarize_runs(FA.repeat_eval(run, RUNS), "metric")


@query("e9_given_coordinates", cte("catalog") + f"SELECT id, round({_given_sql(64, 'id')}, 6) AS pc1, round({_given_sql(65, 'id')}, 6) AS pc2, "
       "round(average_rating, 6) AS average_rating FROM catalog")
def _e9g(f: Fx):
    """Plot data, given coordinates with each item's average rating."""
    coords = f.catalog.select("id", _given(["id"], 64).alias("pc1"), _given(["id"], 65).alias("pc2"))
    return FE.pca_with_values(coords, f.catalog.select("id", "average_rating"))


# ---------------------------------------------------------------------------
# ALS with one factor from given first factors: every step is a quotient of sums

_ALS_REGS, _ALS_ITER, _ALS_SPLITS, _ALS_SEED = [0.1, 1.0], 3, 2, 1


def _given_start(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    m, c = X.split_multipliers(70, 0, 1)
    p = X.SPLIT_PRIME
    at = [((int(i) % p) * m % p + c) % p % GIVEN for i in ids]
    return (np.array(at, np.float32) / GIVEN + 0.5).reshape(-1, 1)


def _als_sql() -> str:
    def held(i: int) -> str:
        m0, m1, c = X.split_multipliers(_ALS_SEED + i, EV.INNER, 2)
        p = X.SPLIT_PRIME
        return f"(((CAST(user_id AS BIGINT) % {p}) * {m0} % {p} + (CAST(item_id AS BIGINT) % {p}) * {m1} % {p} + {c}) % {p} % 100) >= 80"
    steps = [("sp", " UNION ALL ".join(f"SELECT {i} AS split, user_id, item_id, rating, {held(i)} AS held FROM ratings" for i in range(_ALS_SPLITS))),
             ("tr", "SELECT * FROM sp, (VALUES " + ", ".join(f"({r})" for r in _ALS_REGS) + ") g(reg) WHERE NOT held"),
             ("u0", f"SELECT DISTINCT split, reg, user_id, {_given_sql(70, 'user_id')} + 0.5 AS x FROM tr")]
    for k in range(1, _ALS_ITER + 1):
        for new, old, key, other in ((f"i{k}", f"u{k - 1}", "item_id", "user_id"), (f"u{k}", f"i{k}", "user_id", "item_id")):
            steps.append((new, f"SELECT split, reg, {key}, sum(x*rating)/(sum(x*x) + reg*count(*)) AS x FROM tr JOIN {old} USING (split, reg, {other}) "
                               f"GROUP BY split, reg, {key}"))
    return cte("ratings", extra=steps) + (
        f"SELECT CAST(split + {_ALS_SEED} AS INT) AS split_seed, CAST(reg AS DOUBLE) AS reg, round(sqrt(avg((u.x*i.x - rating)*(u.x*i.x - rating))), 3) AS rmse, "
        f"round(avg(abs(u.x*i.x - rating)), 3) AS mae, count(*) AS n_pairs FROM sp JOIN u{_ALS_ITER} u USING (split, user_id) "
        f"JOIN i{_ALS_ITER} i USING (split, reg, item_id) WHERE held GROUP BY split, reg")


@query("m12_rank1_given_start", _als_sql())
def _m12r(f: Fx):
    """M7 + M12 + M14: the grid solver with one factor from given first factors."""
    r = FA.explicit_grid(f.ratings_once, ranks=[1], regs=_ALS_REGS, repeats=_ALS_SPLITS, seed=_ALS_SEED, max_iter=_ALS_ITER, init=_given_start)
    return r.select("split_seed", "reg", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), "n_pairs")


# ---------------------------------------------------------------------------
# per-user models

_BAND = ("bu", f"SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) > {BAND_LO} AND count(*) < {BAND_HI}")
_ROWS = ("rw", "SELECT r.user_id, r.item_id, CASE WHEN r.rating > 3 THEN 1 ELSE 0 END AS y FROM ratings r JOIN bu USING (user_id) JOIN czn ON czn.id = r.item_id")


@query("m16_gradient_given_coefficients", cte("catalog", "ratings", extra=_content_ctes(1)[:4] + [
    ("ix", "SELECT id, nn, dense_rank() OVER (ORDER BY country) AS ci, dense_rank() OVER (ORDER BY flavor) AS fi, "
           "dense_rank() OVER (ORDER BY style) AS si, (SELECT count(DISTINCT country) FROM czn) AS nc, "
           "(SELECT count(DISTINCT flavor) FROM czn) AS nf FROM czn"),
    ("iv", R._K5_DIMS), _BAND, _ROWS,
    ("dm", "SELECT count(DISTINCT country) + count(DISTINCT flavor) + count(DISTINCT style) + 8 AS d FROM czn"),
    ("wj", f"SELECT user_id, j, {_given_sql(14, 'user_id', 'j')} AS w FROM bu, dm, unnest(range(d + 1)) g(j)"),
    ("xv", "SELECT id, j, v FROM iv UNION ALL SELECT id, d, 1.0 FROM czn, dm"),
    ("zz", "SELECT rw.user_id, rw.item_id, rw.y, sum(xv.v*wj.w) AS z FROM rw JOIN xv ON xv.id = rw.item_id "
           "JOIN wj ON wj.user_id = rw.user_id AND wj.j = xv.j GROUP BY 1, 2, 3"),
    ("gj", "SELECT zz.user_id, xv.j, sum((1/(1 + exp(-z)) - y)*xv.v) AS g FROM zz JOIN xv ON xv.id = zz.item_id GROUP BY 1, 2"),
    ("gw", "SELECT wj.user_id, sum((coalesce(g, 0) + w)*(coalesce(g, 0) + w)) AS g2, sum(w*w) AS w2 FROM wj LEFT JOIN gj USING (user_id, j) GROUP BY 1"),
    ("ls", "SELECT user_id, sum(ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END))) AS l FROM zz GROUP BY 1")])
    + "SELECT ls.user_id, round(l + w2/2, 6) AS loss, round(sqrt(g2), 6) AS gradient_norm FROM ls JOIN gw USING (user_id)")
def _m16g(f: Fx):
    """Loss and gradient norm of every banded user's objective (C = 1) at
    given coefficients, by the solver's own sums."""
    from pyspark.ml.functions import vector_to_array
    rows = CL.training_rows(f.ratings_once, f.catalog, CL.band_users(f.ratings_once, BAND_LO, BAND_HI))
    rows = UL.stored_rows(rows.select("user_id", "item_id", "label", vector_to_array("x").alias("x")))     # read four times
    d = rows.select(F.max(F.size("x"))).first()[0] or 0
    coefs = rows.select("user_id").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(d)))).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("j", _given(["user_id", "j"], 14).alias("w")))).alias("w")).select("user_id", F.col("w.w").alias("coef"))
    g = UL.loss_and_gradient(rows, coefs, 1.0)
    return g.select("user_id", "loss", F.sqrt(F.aggregate("gradient", F.lit(0.0), lambda s, x: s + x * x)).alias("gradient_norm"))


def _tree_rows(f: Fx):
    r = f.ratings_once.join(CL.band_users(f.ratings_once, BAND_LO, BAND_HI), "user_id", "left_semi")
    return (r.join(UT.item_bins(f.catalog), "item_id")
            .select("user_id", "item_id", X.preference("rating").cast("int").alias("label"), "f",
                    (X.hash_bucket(["user_id", "item_id"], 0) < 33).alias("test")))


@query("m17_root_splits", cte("catalog", "ratings", extra=_content_ctes(1)[:4] + [_BAND, _ROWS,
    ("fv", " UNION ALL ".join([f"SELECT id, {i} AS feature, lpad(CAST(CAST(least({UT.BINS - 1}, floor((z{i}/sqrt(nn) + 1)*{UT.BINS // 2})) AS INT) AS VARCHAR), 4, '0') AS value FROM czn"
                               for i in range(5)] + [f"SELECT id, {5 + i}, {c} FROM czn" for i, c in enumerate(FE.CATEGORY_FEATURES)])),
    ("ct", "SELECT user_id, feature, value, count(*) AS n, sum(y) AS pos FROM rw JOIN fv ON fv.id = rw.item_id GROUP BY 1, 2, 3"),
    ("tt", "SELECT user_id, count(*) AS an, sum(y) AS ap FROM rw GROUP BY 1 HAVING sum(y) > 0 AND sum(y) < count(*)"),
    ("cu", "SELECT user_id, feature, value, CASE WHEN feature < 5 THEN sum(n) OVER w ELSE n END AS ln, CASE WHEN feature < 5 THEN sum(pos) OVER w ELSE pos END AS lp "
           "FROM ct WINDOW w AS (PARTITION BY user_id, feature ORDER BY value ROWS UNBOUNDED PRECEDING)"),
    ("gn", "SELECT user_id, feature, value, round(2.0*ap*(an - ap)/an - 2.0*lp*(ln - lp)/ln - 2.0*(ap - lp)*((an - ln) - (ap - lp))/(an - ln), 9) AS gain "
           "FROM cu JOIN tt USING (user_id) WHERE ln < an"),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, feature, value) AS r FROM gn")])
    + "SELECT user_id, CAST(feature AS INT) AS feature, value, round(gain, 6) AS gain FROM rk WHERE r = 1")
def _m17s(f: Fx):
    """The first split of every banded user's tree, over all their rows."""
    rows = _tree_rows(f).withColumn("node", F.lit(1).cast("long"))
    return UT.best_splits(rows).select("user_id", "feature", "value", "gain")


@query("m17_per_user_trees")
def _m17t(f: Fx):
    """M17 + A20: a tree for each banded user, grown together; accuracy per user
    on the test split."""
    return UT.per_user_trees(_tree_rows(f))["per_user"]


@query("e8_pca_block_iteration")
def _e8b(f: Fx):
    """Components of the raw numeric and one-hot features by block power
    iteration over the long table: share of each component."""
    c = FE.fill_missing(FE.drop_for_pca(f.catalog))
    num = c.select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).cast("double").alias("value")) for x in FE.NUMERIC_FEATURES])).alias("_f"))
    long = num.select("id", "_f.dim", "_f.value").unionByName(FE.one_hot_long(c, "id", FE.CATEGORY_FEATURES))
    got = WP.principal_components(long, 2)
    return f.spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(got["explained"])], "component int, ratio double")


# ---------------------------------------------------------------------------
# sketches and published tables

_A2 = ["user_id", "item_id"]


@query("a2_sketch_counts", cte("ratings", "purchases") + " UNION ALL ".join(
    [f"SELECT 'ratings' AS scope, '{c}' AS \"column\", count(DISTINCT {c}) AS n_exact, true AS within_bound FROM ratings" for c in _A2]
    + [f"SELECT tier, '{c}', count(DISTINCT {c}), true FROM purchases GROUP BY tier" for c in _A2]
    + [f"SELECT 'all tiers', '{c}', count(DISTINCT {c}), true FROM purchases" for c in _A2]))
def _a2s(f: Fx):
    """A2 (approx): distinct users and items of the ratings, of each tier and of
    all tiers, the last from the tiers' stored sketches alone; exact counts
    beside them, and whether the estimate keeps its bound."""
    path = scratch_path(f.spark, "sketches")
    (SKE.distinct_sketches(f.ratings, _A2).withColumn("scope", F.lit("ratings"))
     .unionByName(SKE.distinct_sketches(f.purchases, _A2, ["tier"]).withColumnRenamed("tier", "scope")).write.parquet(path))
    held = f.spark.read.parquet(path)
    union = SKE.combined(held.filter("scope <> 'ratings'")).withColumn("scope", F.lit("all tiers"))
    est = SKE.estimates(held.select("scope", "column", "sketch").unionByName(union.select("scope", "column", "sketch")))
    exact = None
    for scope, d in (("ratings", f.ratings.withColumn("scope", F.lit("ratings"))), ("tier", f.purchases.withColumn("scope", F.col("tier"))),
                     ("all", f.purchases.withColumn("scope", F.lit("all tiers")))):
        for c in _A2:
            e = d.groupBy("scope").agg(F.count_distinct(c).cast("long").alias("n_exact")).withColumn("column", F.lit(c))
            exact = e if exact is None else exact.unionByName(e)
    return exact.join(est, ["scope", "column"]).select("scope", "column", "n_exact", SKE.within_bound(F.col("n_estimate"), F.col("n_exact")).alias("within_bound"))


def _published_recs(f: Fx):
    folder = scratch_path(f.spark, "published-recs")
    PB.publish(R._knn_recs(f, "item"), folder, "user_id", ["rank"])
    return PB.current(f.spark, folder)


@query("s9_published_reco_table", R.ORACLE_SQL["s9_user_reco_table"])
def _s9p(f: Fx):
    """The per-user table published as a version, bucketed by user, and read
    through the pointer."""
    return _published_recs(f)


@query("s10_published_lookup", R.ORACLE_SQL["s10_lookup_top_user"])
def _s10p(f: Fx):
    """S10 + F6 + O5: point read of the published table: one bucket is read."""
    from reco.sources import sinks as SK
    uid = most_active(f.ratings).first()["user_id"]      # one scalar
    return SK.lookup(_published_recs(f), "user_id", int(uid), R.SERVE_N)


@query("q2_published_similar_items", R.ORACLE_SQL["q2_similar_items"])
def _q2p(f: Fx):
    """Q2 over the published similarity table: the join reads its buckets as they lie."""
    folder = scratch_path(f.spark, "published-similarity")
    PB.publish(content_similarity(f.catalog, top_k=R.SIM_TOP), folder, "item1", ["rank"])
    who = most_active(f.ratings).select("user_id")
    req = f.ratings.join(who, "user_id").select(F.col("item_id").alias("item1"))
    return serve.similar_items(req, PB.current(f.spark, folder), R.SIM_TOP)
