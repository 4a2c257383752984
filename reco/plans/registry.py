"""The registered query set: Spark callables and their DuckDB SQL twins.

Every query reads the driver tables through the fixture views (FIXTURES.md)
and runs over whole tables.  Doubles are rounded to 6 digits on output and
ranks use an explicit total order (rounded score, then id), so both engines
agree exactly (SURVEY §7.4).  Queries whose result depends on a fitted
model (ALS, logistic regression, trees, PCA, LSH) have no SQL twin.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reco import fixtures as fx
from reco.fixtures import cte
from reco.functions import columns as X
from reco.operators import aggregates as A
from reco.operators import evaluate as EV
from reco.operators import features as FE
from reco.operators import interactions as IN
from reco.operators import neighborhood as NB
from reco.operators import popularity as PO
from reco.operators.ranking import rank_in_group
from reco.operators.similarity import content_similarity, rating_similarity
from reco.plans import serve
from reco.deploy import ship_package
from reco.session import app_scratch_dir, ensure_checkpoint_dir, stored
from reco.sources import readers as RD
from reco.sources import sinks as SK
from reco.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Fixed parameters of the registered queries (the reference's values where it
# has them; support thresholds and activity bands sized for the fixtures).
CONTENT_K = 200      # M4 neighbours
RATING_K = 10        # M5 / M6 neighbours
SIM_TOP = 10         # stored similarity rows per item
RECO_TOP_CONTENT = 30
RECO_TOP_RATING = 50
SERVE_N = 10
MIN_SUPPORT = 2
BAND_LO, BAND_HI = 50, 100
POP_TOP = 100
SPLIT_SEED = 42


class Fx:
    """Lazy fixture DataFrames for one (session, sf_dir)."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark = spark
        self.t = Tables(spark, sf)

    @cached_property
    def ratings(self) -> DataFrame:
        return fx.ratings(self.t)

    @cached_property
    def ratings_once(self) -> DataFrame:
        """The ratings for a query that reads them several times: worked out
        once and kept in the shared folder."""
        ensure_checkpoint_dir(self.spark)
        return self.ratings.select("user_id", "item_id", "rating").checkpoint(eager=True)

    @cached_property
    def ratings_stored(self) -> DataFrame:
        """``ratings_once`` as a table, for the neighbour queries."""
        return stored(self.ratings.select("user_id", "item_id", "rating"), "ratings")

    @cached_property
    def catalog(self) -> DataFrame:
        t = self.t
        return RD.item_catalog(fx.beers(t), fx.brands(t), fx.origins(t), fx.flavors(t), fx.styles(t))

    @cached_property
    def purchases(self) -> DataFrame:
        return fx.purchases(self.t)

    @cached_property
    def purchases_fine(self) -> DataFrame:
        return fx.purchases_fine(self.t)

    @cached_property
    def users(self) -> DataFrame:
        return fx.users(self.t)

    @cached_property
    def titles(self) -> DataFrame:
        return fx.titles(self.t)


def finalize(df: DataFrame) -> DataFrame:
    """Round doubles to 6 digits; ranks and counts as bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif f.name in ("rank", "idx") and isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return finalize(fn(Fx(spark, sf)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run
    return deco


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{app_scratch_dir(spark).rstrip('/')}/exports/{what}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------
# SQL building blocks shared by several oracle queries

_Z = ["number_of_ratings", "average_aroma_rating", "average_appearance_rating",
      "average_taste_rating", "average_body_rating"]


def _content_ctes(k: int) -> list[tuple[str, str]]:
    zc = ", ".join(f"coalesce({c}, 0) AS x{i}" for i, c in enumerate(_Z))
    st = ", ".join(f"avg(x{i}) AS m{i}, stddev_samp(x{i}) AS s{i}" for i in range(5))
    zz = ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in range(5))
    dot = (" + ".join(f"a.z{i}*b.z{i}" for i in range(5))
           + " + CAST(a.country = b.country AS INT) + CAST(a.flavor = b.flavor AS INT)"
           + " + CAST(a.style = b.style AS INT)")
    return [
        ("cf", f"SELECT id, coalesce(country, '0') AS country, coalesce(flavor, '0') AS flavor, "
               f"coalesce(style, '0') AS style, {zc} FROM catalog"),
        ("cst", f"SELECT {st} FROM cf"),
        ("cz", f"SELECT id, country, flavor, style, {zz} FROM cf, cst"),
        ("czn", "SELECT *, z0*z0 + z1*z1 + z2*z2 + z3*z3 + z4*z4 + 3 AS nn FROM cz"),
        ("cpairs", f"SELECT a.id AS item1, b.id AS item2, "
                   f"2*(1 - ({dot}) / (sqrt(a.nn)*sqrt(b.nn))) AS score FROM czn a JOIN czn b ON a.id <> b.id"),
        ("csim", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item1 "
                 f"ORDER BY round(score, 9), item2) AS rank FROM cpairs) WHERE rank <= {k}"),
    ]


def _rating_sim_ctes(entity: str, k: int, prefix: str) -> list[tuple[str, str]]:
    key, dim = ("user_id", "item_id") if entity == "user" else ("item_id", "user_id")
    e1, e2 = f"{entity}1", f"{entity}2"
    return [
        (f"{prefix}n", f"SELECT {key} AS id, sum(rating*rating) AS nn FROM ratings GROUP BY {key}"),
        (f"{prefix}d", f"SELECT a.{key} AS {e1}, b.{key} AS {e2}, sum(a.rating*b.rating) AS dot "
                       f"FROM ratings a JOIN ratings b ON a.{dim} = b.{dim} AND a.{key} <> b.{key} "
                       f"GROUP BY 1, 2 HAVING sum(a.rating*b.rating) <> 0"),
        (f"{prefix}s", f"SELECT {e1}, {e2}, dot / (sqrt(n1.nn)*sqrt(n2.nn)) AS score FROM {prefix}d "
                       f"JOIN {prefix}n n1 ON n1.id = {e1} JOIN {prefix}n n2 ON n2.id = {e2}"),
        (f"{prefix}sim", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {e1} "
                         f"ORDER BY score DESC, {e2}) AS rank FROM {prefix}s) WHERE rank <= {k}"),
    ]


def _pred_ctes(nb_sql: str, by: str) -> list[tuple[str, str]]:
    """(target, neighbour, weight) -> predictions p(user_id, item_id, pred)."""
    if by == "item":
        agg = ("SELECT r.user_id, nb.target AS item_id, sum(nb.weight*r.rating) AS num, "
               "sum(abs(nb.weight)) AS den FROM nb JOIN ratings r ON r.item_id = nb.nbr GROUP BY 1, 2")
    else:
        agg = ("SELECT nb.target AS user_id, r.item_id, sum(nb.weight*r.rating) AS num, "
               "sum(abs(nb.weight)) AS den FROM nb JOIN ratings r ON r.user_id = nb.nbr GROUP BY 1, 2")
    return [("nb", nb_sql), ("pa", agg),
            ("p", "SELECT user_id, item_id, num/den AS pred FROM pa WHERE num > 0")]


def _recs_sql(n: int) -> str:
    return (f"SELECT user_id, item_id, round(pred, 6) AS pred_rating, rank FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(pred, 9) DESC, item_id) AS rank "
            f"FROM (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM ratings r "
            f"WHERE r.user_id = p.user_id AND r.item_id = p.item_id))) WHERE rank <= {n}")


_MAE_SQL = ("SELECT round(avg(abs(p.pred - r.rating)), 6) AS mae, count(*) AS n_pairs "
            "FROM p JOIN ratings r ON r.user_id = p.user_id AND r.item_id = p.item_id")

_INTER_BODY = {
    "pc": "SELECT user_id, item_id, tier, CAST(count(*) AS DOUBLE) AS n FROM {src} "
          "WHERE tier IN ('recent', 'more_recent') GROUP BY 1, 2, 3",
    "wt": "SELECT CAST(user_id AS INT) AS user_id, CAST(item_id AS INT) AS item_id, tier, "
          "CASE WHEN tier = 'more_recent' THEN n * 2.0 "
          "WHEN tier = 'recent' THEN (CASE WHEN n <= 2.0 THEN 0.0 ELSE n END) * 1.0 ELSE n END AS rating FROM pc",
    "inter": "SELECT user_id, item_id, sum(rating) AS rating FROM wt GROUP BY 1, 2",
}


def _inter_ctes(src: str) -> list[tuple[str, str]]:
    return [(k, v.format(src=src)) for k, v in _INTER_BODY.items()]


def _bucket(seed: int, buckets: int = 100, cols: tuple = ("user_id", "item_id")) -> str:
    *m, c = X.split_multipliers(seed, n=len(cols))
    p = X.SPLIT_PRIME
    terms = " + ".join(f"(CAST({col} AS BIGINT) % {p}) * {k} % {p}" for col, k in zip(cols, m))
    return f"(({terms} + {c}) % {p} % {buckets})"


# ---------------------------------------------------------------------------
# S: sources and sinks

@query("s1_item_catalog", cte("catalog") + "SELECT id, country, flavor, style, round(average_rating, 6) AS average_rating, "
       "number_of_ratings, round(average_aroma_rating, 6) AS average_aroma_rating, "
       "round(average_appearance_rating, 6) AS average_appearance_rating, "
       "round(average_taste_rating, 6) AS average_taste_rating, "
       "round(average_body_rating, 6) AS average_body_rating FROM catalog")
def _s1(f: Fx):
    """S1 + F1 + F3 + J1 + J2 + O3: item catalog star join, rated items only,
    ordered by id."""
    return f.catalog.orderBy("id")


@query("s2_ratings_scan", cte("ratings") + "SELECT user_id, item_id, rating, CAST(rated_at AS VARCHAR) AS rated_at "
       "FROM ratings WHERE user_id IS NOT NULL OR item_id IS NOT NULL")
def _s2(f: Fx):
    """S2 + F5: ratings with the OR null predicate."""
    r = RD.ratings_scan(f.ratings)
    return r.withColumn("rated_at", F.date_format("rated_at", "yyyy-MM-dd HH:mm:ss"))


@query("s3_user_profiles", cte("users") + "SELECT id, first_name, last_name, email FROM users")
def _s3(f: Fx):
    """S3: user projection."""
    return RD.user_profiles(f.users)


@query("s4_ratings_csv_roundtrip", cte("ratings") + "SELECT CAST(user_id AS INT) AS user_id, CAST(item_id AS INT) "
       "AS item_id, CAST(CAST(rating AS FLOAT) AS DOUBLE) AS rating FROM ratings")
def _s4(f: Fx):
    """S12 + S4 (+X1, X2, S6): export ratings as header-less CSV to the shared
    folder, read them back typed by an explicit schema."""
    path = scratch_path(f.spark, "ratings-csv")
    SK.export_csv(f.ratings.select("user_id", "item_id", "rating"), path, header=False)
    return RD.read_ratings_csv(f.spark, path)


@query("s5_purchases_csv_roundtrip", cte("purchases") + "SELECT CAST(user_id AS INT) AS user_id, "
       "CAST(item_id AS INT) AS item_id FROM purchases")
def _s5(f: Fx):
    """Header CSV of purchases, read with an explicit schema, cast."""
    path = scratch_path(f.spark, "purchases-csv")
    SK.export_csv(f.purchases.select("user_id", "item_id"), path, header=True)
    r = RD.read_purchases_csv(f.spark, path)
    return r.select(X.to_int("user_id").alias("user_id"), X.to_int("item_id").alias("item_id"))


@query("s7_best_rated_table", cte("catalog") + "SELECT id AS item_id, round(average_rating, 6) AS rating, "
       "number_of_ratings AS count, row_number() OVER (ORDER BY average_rating DESC, id) AS rank "
       "FROM catalog WHERE number_of_ratings > 0")
def _s7(f: Fx):
    """S7 + M3 + O1: the full best-rated table with a stored global rank,
    written (full refresh) and read back."""
    path = scratch_path(f.spark, "best-rated")
    SK.write_table(PO.best_rated(f.catalog), path)
    return SK.read_back(f.spark, path)


@query("s11_temp_view_sql", cte("catalog") + "SELECT id AS item_id, round(average_rating, 6) AS rating, "
       "number_of_ratings AS count FROM catalog WHERE number_of_ratings > 2 "
       "ORDER BY average_rating DESC, id LIMIT 50")
def _s11(f: Fx):
    """Temp view + SQL text over it (top-50 report)."""
    RD.register_view(f.catalog, "item_catalog")
    return f.spark.sql("SELECT id AS item_id, average_rating AS rating, number_of_ratings AS count "
                       "FROM item_catalog WHERE number_of_ratings > 2 "
                       "ORDER BY average_rating DESC, id LIMIT 50")


@query("s13_catalog_shape", cte("catalog") + "SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_cols FROM catalog")
def _s13(f: Fx):
    """S13 + A1: rows and columns of the catalog."""
    c = f.catalog
    return c.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.lit(len(c.columns)).cast("bigint").alias("n_cols"))


# ---------------------------------------------------------------------------
# F: filters

@query("f8_filled_catalog", cte("catalog") + "SELECT id, country, coalesce(flavor, '0') AS flavor, "
       "coalesce(style, '0') AS style, round(coalesce(average_rating, 0), 6) AS average_rating FROM catalog")
def _f8(f: Fx):
    """F8 / D3: missing values filled with 0 (strings with "0")."""
    return FE.fill_missing(f.catalog).select("id", "country", "flavor", "style", "average_rating")


@query("f12_activity_band", cte("ratings") + f"SELECT user_id, count(*) AS n_ratings FROM ratings "
       f"GROUP BY user_id HAVING count(*) > {BAND_LO} AND count(*) < {BAND_HI}")
def _f12(f: Fx):
    """users with BAND_LO < n < BAND_HI ratings (bounds exclusive)."""
    c = A.count_per(f.ratings, ["user_id"], "n_ratings")
    return c.filter((F.col("n_ratings") > BAND_LO) & (F.col("n_ratings") < BAND_HI))


@query("f13_training_guard", cte("ratings", extra=[
    ("tr", f"SELECT user_id, CASE WHEN rating > 3 THEN 1 ELSE 0 END AS label FROM ratings "
           f"WHERE user_id IN (SELECT user_id FROM ratings GROUP BY user_id "
           f"HAVING count(*) > {BAND_LO} AND count(*) < {BAND_HI}) AND {_bucket(SPLIT_SEED)} < 67")])
    + "SELECT user_id, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, "
      "(sum(label) >= 5 AND count(*) - sum(label) >= 5) AS trainable FROM tr GROUP BY user_id")
def _f13(f: Fx):
    """Per-user class counts in the training split of the activity
    band; trainable when both classes have at least 5 rows."""
    from reco.operators.classify import class_guard, band_users
    band = band_users(f.ratings, BAND_LO, BAND_HI)
    train, _ = EV.hash_split(f.ratings.join(band, "user_id", "left_semi"), SPLIT_SEED, 67)
    return class_guard(train.withColumn("label", X.preference("rating")))


@query("f14_class_listing", cte("ratings", extra=[
    ("top", "SELECT user_id FROM ratings GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1")])
    + "SELECT user_id, item_id, rating, CASE WHEN rating > 3 THEN 'like' ELSE 'dislike' END AS class, rank FROM ("
      "SELECT r.*, row_number() OVER (PARTITION BY rating > 3 ORDER BY item_id) AS rank "
      "FROM ratings r JOIN top USING (user_id)) WHERE rank <= 30")
def _f14(f: Fx):
    """F14 (+A6): the most active user's liked (> 3) and disliked (<= 3)
    items, first 30 of each by item id."""
    who = A.most_active(f.ratings).select("user_id")
    h = f.ratings.join(who, "user_id").withColumn("class", F.when(F.col("rating") > 3, "like").otherwise("dislike"))
    from reco.operators.ranking import top_n_per_group
    r = top_n_per_group(h, ["class"], [F.col("item_id").asc()], 30)
    return r.select("user_id", "item_id", "rating", "class", "rank")


# ---------------------------------------------------------------------------
# A: aggregates

@query("a1_a2_counts", cte("ratings") + "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_user_id, "
       "count(DISTINCT item_id) AS n_item_id FROM ratings")
def _a1(f: Fx):
    """A1 + A2: rows, distinct users, distinct items."""
    r = f.ratings
    return r.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.count_distinct("user_id").cast("bigint").alias("n_user_id"),
                 F.count_distinct("item_id").cast("bigint").alias("n_item_id"))


@query("a3_a4_item_counts_means", cte("ratings") + "SELECT item_id, round(avg(rating), 6) AS avg_rating, "
       "count(*) AS n FROM ratings GROUP BY item_id")
def _a3(f: Fx):
    """A3 + A4: count and mean rating per item."""
    return PO.item_means(f.ratings)


@query("a5_purchase_pair_counts", cte("purchases") + "SELECT user_id, item_id, tier, count(*) AS n "
       "FROM purchases GROUP BY 1, 2, 3")
def _a5(f: Fx):
    """A5: purchases per (user, item, tier)."""
    return A.count_per(f.purchases, ["user_id", "item_id", "tier"], "n")


@query("a6_most_active_user", cte("ratings") + "SELECT user_id, count(*) AS n_ratings FROM ratings "
       "GROUP BY user_id ORDER BY n_ratings DESC, user_id LIMIT 1")
def _a6(f: Fx):
    """The most active user (smallest id wins a tie)."""
    return A.most_active(f.ratings)


@query("a7_a8_feature_stats", cte("catalog") + "SELECT " + ", ".join(
    f"round(avg(coalesce({c}, 0)), 6) AS avg_{c}, round(stddev_samp(coalesce({c}, 0)), 6) AS std_{c}" for c in _Z)
    + " FROM catalog")
def _a7(f: Fx):
    """A7 + A8: column means and sample std over the filled catalog."""
    return A.column_stats(FE.fill_missing(f.catalog), FE.NUMERIC_FEATURES)


@query("a9_item_vector_norms", cte("ratings") + "SELECT item_id, round(sqrt(sum(rating*rating)), 6) AS norm "
       "FROM ratings GROUP BY item_id")
def _a9(f: Fx):
    """L2 norm of each item's rating vector."""
    return A.l2_norms(f.ratings.select("item_id", F.col("rating").alias("value")), "item_id")


@query("a18_latest_rating", cte("ratings") + "SELECT user_id, item_id, rating, CAST(rated_at AS VARCHAR) AS rated_at "
       "FROM ratings")
def _a18(f: Fx):
    """Last rating per (user, item) from the raw events."""
    return f.ratings.withColumn("rated_at", F.date_format("rated_at", "yyyy-MM-dd HH:mm:ss"))


@query("a19_distinct_items", cte("ratings") + "SELECT DISTINCT item_id FROM ratings")
def _a19(f: Fx):
    """Distinct rated items."""
    return A.distinct_values(f.ratings, "item_id")


@query("a23_vector_space_shape", cte("catalog") + "SELECT count(*) AS n_vectors, "
       "CAST(5 + (SELECT count(DISTINCT coalesce(country, '0')) FROM catalog) "
       "+ (SELECT count(DISTINCT coalesce(flavor, '0')) FROM catalog) "
       "+ (SELECT count(DISTINCT coalesce(style, '0')) FROM catalog) AS BIGINT) AS n_dims FROM catalog")
def _a23(f: Fx):
    """Number of content vectors and dimension of the space."""
    return A.vector_space_shape(FE.content_vectors_long(f.catalog), "id", "dim")


# ---------------------------------------------------------------------------
# E: features

@query("e1_one_hot_long", cte("catalog") + "SELECT id, 'country_' || coalesce(country, '0') AS dim, 1.0 AS value FROM catalog "
       "UNION ALL SELECT id, 'flavor_' || coalesce(flavor, '0'), 1.0 FROM catalog "
       "UNION ALL SELECT id, 'style_' || coalesce(style, '0'), 1.0 FROM catalog")
def _e1(f: Fx):
    """Long one-hot of the three category columns (missing = "0")."""
    return FE.one_hot_long(FE.fill_missing(f.catalog), "id", FE.CATEGORY_FEATURES)


@query("e2_standardized", cte("catalog", extra=_content_ctes(1)[:3])
       + "SELECT id, " + ", ".join(f"round(z{i}, 6) AS z_{c}" for i, c in enumerate(_Z)) + " FROM cz")
def _e2(f: Fx):
    """Z-scores of the five numeric features."""
    return FE.content_features(f.catalog).select("id", *FE.Z_COLS)


@query("e4_content_vectors_long", cte("catalog", extra=_content_ctes(1)[:4] + [
    ("lv", " UNION ALL ".join(f"SELECT id, '{c}' AS dim, z{i} AS value, nn FROM czn" for i, c in enumerate(_Z))
     + " UNION ALL SELECT id, 'country_' || country, 1.0, nn FROM czn"
       " UNION ALL SELECT id, 'flavor_' || flavor, 1.0, nn FROM czn"
       " UNION ALL SELECT id, 'style_' || style, 1.0, nn FROM czn")])
    + "SELECT id, dim, round(value / sqrt(nn), 6) AS value FROM lv")
def _e4(f: Fx):
    """E4 (E2 + E1 + E3): unit content vectors in long form."""
    return FE.content_vectors_long(f.catalog)


@query("e5_user_vectors", cte("ratings", extra=[
    ("n", "SELECT user_id, sqrt(sum(rating*rating)) AS nrm FROM ratings GROUP BY user_id")])
    + "SELECT r.user_id AS id, r.item_id AS dim, round(r.rating / n.nrm, 6) AS value FROM ratings r JOIN n USING (user_id)")
def _e5(f: Fx):
    """E5: unit user rating vectors (over items), long form."""
    return FE.rating_vectors(f.ratings, "user")


@query("e6_item_vectors", cte("ratings", extra=[
    ("n", "SELECT item_id, sqrt(sum(rating*rating)) AS nrm FROM ratings GROUP BY item_id")])
    + "SELECT r.item_id AS id, r.user_id AS dim, round(r.rating / n.nrm, 6) AS value FROM ratings r JOIN n USING (item_id)")
def _e6(f: Fx):
    """Unit item rating vectors (over users), long form."""
    return FE.rating_vectors(f.ratings, "item")


@query("e6b_item_vectors_centered", cte("ratings", extra=[
    ("m", "SELECT item_id, avg(rating) AS mu FROM ratings GROUP BY item_id"),
    ("c", "SELECT r.item_id, r.user_id, r.rating - m.mu AS v FROM ratings r JOIN m USING (item_id)"),
    ("n", "SELECT item_id, sqrt(sum(v*v)) AS nrm FROM c GROUP BY item_id HAVING sum(v*v) > 0")])
    + "SELECT c.item_id AS id, c.user_id AS dim, round(c.v / n.nrm, 6) AS value FROM c JOIN n USING (item_id)")
def _e6b(f: Fx):
    """E6 with the mean-centering option (the commented-out variant);
    constant vectors have no direction and are dropped."""
    return FE.rating_vectors(f.ratings, "item", center=True)


@query("e7_dense_item_index", cte("ratings") + "SELECT item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS idx "
       "FROM (SELECT DISTINCT item_id FROM ratings)")
def _e7(f: Fx):
    """Dense 0-based index of rated item ids."""
    return FE.dense_index(f.ratings, "item_id")


# ---------------------------------------------------------------------------
# K: similarity

@query("k1_content_similarity", cte("catalog", extra=_content_ctes(SIM_TOP))
       + "SELECT item1, item2, round(score, 6) AS score, rank FROM csim")
def _k1(f: Fx):
    """K1 + J5 + A10 + W1: content item-item distance over all pairs (the
    theta join done as blocked matrix products), top SIM_TOP per item."""
    return content_similarity(f.catalog, top_k=SIM_TOP)


@query("k2_item_rating_similarity", cte("ratings", extra=_rating_sim_ctes("item", SIM_TOP, "it"))
       + "SELECT item1, item2, round(score, 6) AS score, rank FROM itsim")
def _k2(f: Fx):
    """K2 + J6 + A10 + W1: item-item cosine of rating vectors (co-rating
    products computed block-wise), top SIM_TOP per item."""
    return rating_similarity(f.ratings, "item", top_k=SIM_TOP)


@query("k3_user_rating_similarity", cte("ratings", extra=_rating_sim_ctes("user", SIM_TOP, "u"))
       + "SELECT user1, user2, round(score, 6) AS score, rank FROM usim")
def _k3(f: Fx):
    """K3 + J6 + A10 + W1: user-user cosine of rating vectors, top SIM_TOP per
    user."""
    return rating_similarity(f.ratings, "user", top_k=SIM_TOP)


# ---------------------------------------------------------------------------
# M: predictors and baselines

_M4_CTES = _content_ctes(CONTENT_K) + _pred_ctes(
    "SELECT item1 AS target, item2 AS nbr, 1 - score/2 AS weight FROM csim", "item")
_M5_CTES = _rating_sim_ctes("item", RATING_K, "it") + _pred_ctes(
    "SELECT item1 AS target, item2 AS nbr, score AS weight FROM itsim", "item")
_M6_CTES = _rating_sim_ctes("user", RATING_K, "u") + _pred_ctes(
    "SELECT user1 AS target, user2 AS nbr, score AS weight FROM usim", "user")


@query("m4_content_knn_recs", cte("catalog", "ratings", extra=_M4_CTES) + _recs_sql(RECO_TOP_CONTENT))
def _m4r(f: Fx):
    """M4 + J7 + A11 + F11 + J8 + W5 + S9: content item kNN (k=200),
    top 30 unseen items per user."""
    nb, by = NB.neighbors_for("content", f.ratings_once, f.catalog, CONTENT_K)
    return NB.knn_recommendations(nb, f.ratings_once, by, RECO_TOP_CONTENT)


@query("m4_content_knn_mae", cte("catalog", "ratings", extra=_M4_CTES) + _MAE_SQL)
def _m4e(f: Fx):
    """M4 + J9 + A12: MAE of content kNN on already-rated pairs."""
    nb, by = NB.neighbors_for("content", f.ratings_stored, f.catalog, CONTENT_K)
    return NB.knn_mae(nb, f.ratings_stored, by)


def _knn_recs(f: Fx, kind: str) -> DataFrame:
    """J7, A11, F11, J8, W5 as joins and aggregates over k=10 neighbours."""
    nb, by = NB.neighbors_for(kind, f.ratings_stored, k=RATING_K)
    return NB.join_recommendations(nb, f.ratings_stored, by, RECO_TOP_RATING)


def _knn_mae(f: Fx, kind: str) -> DataFrame:
    nb, by = NB.neighbors_for(kind, f.ratings_stored, k=RATING_K)
    return NB.join_mae(nb, f.ratings_stored, by)


@query("m5_item_knn_recs", cte("ratings", extra=_M5_CTES) + _recs_sql(RECO_TOP_RATING))
def _m5r(f: Fx):
    """M5: item kNN over rating vectors (k=10), top 50 unseen per user."""
    return _knn_recs(f, "item")


@query("m5_item_knn_mae", cte("ratings", extra=_M5_CTES) + _MAE_SQL)
def _m5e(f: Fx):
    """M5 + J9 + A12."""
    return _knn_mae(f, "item")


@query("m6_user_knn_recs", cte("ratings", extra=_M6_CTES) + _recs_sql(RECO_TOP_RATING))
def _m6r(f: Fx):
    """M6: user kNN over rating vectors (k=10), top 50 unseen per user."""
    return _knn_recs(f, "user")


@query("m6_user_knn_mae", cte("ratings", extra=_M6_CTES) + _MAE_SQL)
def _m6e(f: Fx):
    """M6 + J9 + A12."""
    return _knn_mae(f, "user")


@query("m1_catalog_baseline_mae", cte("catalog", "ratings") + "SELECT round(avg(abs(r.rating - c.average_rating)), 6) "
       "AS mae, count(*) AS n_pairs FROM ratings r JOIN catalog c ON c.id = r.item_id WHERE c.number_of_ratings > 0")
def _m1(f: Fx):
    """M1 (J3 + A12): catalog-average baseline MAE."""
    return PO.catalog_baseline_mae(f.catalog, f.ratings)


def _m2_sql(fit_all: bool) -> str:
    fit = "ratings" if fit_all else f"(SELECT * FROM ratings WHERE {_bucket(SPLIT_SEED)} < 80)"
    return cte("ratings", extra=[
        ("te", f"SELECT * FROM ratings WHERE {_bucket(SPLIT_SEED)} >= 80"),
        ("mu", f"SELECT item_id, avg(rating) AS m FROM {fit} t GROUP BY item_id"),
        ("g", f"SELECT avg(rating) AS gm FROM {fit} t"),
        ("pr", "SELECT te.rating, coalesce(mu.m, g.gm) AS pred FROM te LEFT JOIN mu USING (item_id), g")]) + \
        ("SELECT round(sqrt(avg((rating - pred)*(rating - pred))), 6) AS rmse, "
         "round(avg(abs(rating - pred)), 6) AS mae, count(*) AS n_pairs FROM pr")


@query("m2_item_mean_baseline", _m2_sql(False))
def _m2(f: Fx):
    """M2 + M18 + A13 + X12 (D12 default): item means fitted on the 80% split,
    global-mean fallback, RMSE/MAE on the 20% split."""
    train, test = EV.hash_split(f.ratings, SPLIT_SEED, 80)
    return PO.item_mean_baseline(train, test)


@query("m2b_item_mean_baseline_all", _m2_sql(True))
def _m2b(f: Fx):
    """M2 as in the reference (D12 "all"): item means from all ratings."""
    _, test = EV.hash_split(f.ratings, SPLIT_SEED, 80)
    return PO.item_mean_baseline(f.ratings, test)


@query("m3_best_rated_top", cte("catalog") + f"SELECT id AS item_id, round(average_rating, 6) AS rating, "
       f"number_of_ratings AS count, row_number() OVER (ORDER BY average_rating DESC, id) AS rank FROM catalog "
       f"WHERE number_of_ratings > {MIN_SUPPORT} ORDER BY average_rating DESC, id LIMIT {SERVE_N}")
def _m3(f: Fx):
    """M3 + F2 + F4 + O1: best-rated items with support > MIN_SUPPORT, top 10."""
    return PO.best_rated(f.catalog, MIN_SUPPORT, SERVE_N)


@query("m11_item_counts_and_means", cte("ratings", "titles") + "SELECT t.item_id, coalesce(s.c, 0) AS count, "
       "round(s.m, 6) AS avg_rating FROM titles t LEFT JOIN (SELECT item_id, count(*) AS c, avg(rating) AS m "
       "FROM ratings GROUP BY item_id) s USING (item_id)")
def _m11(f: Fx):
    """M11 (J11 + A3 + A4): counts including unrated items, and means."""
    return PO.item_counts_and_means(f.ratings, f.titles)


@query("m18_split_sizes", cte("ratings") + f"SELECT CASE WHEN {_bucket(SPLIT_SEED)} < 80 THEN 'train' ELSE 'test' END "
       f"AS split, count(*) AS n_rows, round(sum(rating), 6) AS sum_rating FROM ratings GROUP BY 1")
def _m18(f: Fx):
    """M18 + A1 + A16: sizes and weights of the deterministic 80/20 split."""
    b = X.hash_bucket(["user_id", "item_id"], SPLIT_SEED)
    return (f.ratings.withColumn("split", F.when(b < 80, "train").otherwise("test"))
            .groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                  F.sum("rating").alias("sum_rating")))


# ---------------------------------------------------------------------------
# Interactions, popularity, MPR

@query("m15_interactions", cte("purchases", extra=_inter_ctes("purchases"))
       + "SELECT user_id, item_id, round(rating, 6) AS rating FROM inter")
def _m15(f: Fx):
    """M15 + X3 + X6 + U1 + D13: tier-weighted interaction strengths."""
    return IN.build_interactions(f.purchases)


@query("u1_tier_union", cte("purchases", extra=_inter_ctes("purchases"))
       + "SELECT user_id, item_id, tier, round(rating, 6) AS rating FROM wt")
def _u1(f: Fx):
    """Bag union of the weighted tiers, not re-aggregated."""
    return IN.weighted_tiers(f.purchases)


@query("x_confidence_functions", cte("purchases") + "SELECT user_id, item_id, tier, n, "
       "CASE WHEN n <= 2 THEN 0.0 ELSE n END AS step, "
       "round(ln(1.005 + n*100000000.0) + n, 6) AS log_conf, "
       "round(ln(1.005 + n) + n, 6) AS log_conf_v1, "
       "round(ln(1.005 + n*100.0), 6) AS log_conf_v2, "
       "CASE WHEN tier = 'more_recent' THEN 2.0*n ELSE n END AS tier_weighted, "
       "CASE WHEN n/10.0 > 0.7 THEN 1.0 ELSE 0.0 END AS like_label "
       "FROM (SELECT user_id, item_id, tier, CAST(count(*) AS DOUBLE) AS n FROM purchases GROUP BY 1, 2, 3)")
def _x(f: Fx):
    """X3 + X4 + X5 + X6 + X11 over per-tier pair counts."""
    c = IN.pair_counts(f.purchases)
    return c.select("user_id", "item_id", "tier", "n",
                    X.confidence_step("n", 2.0).alias("step"),
                    X.log_confidence("n").alias("log_conf"),
                    X.log_confidence("n", scale=1.0).alias("log_conf_v1"),
                    X.log_confidence("n", scale=100.0, add_linear=False).alias("log_conf_v2"),
                    X.tier_weight("n", "tier", {"more_recent": 2.0}).alias("tier_weighted"),
                    X.like_label(F.col("n") / 10.0).alias("like_label"))


@query("x7_preference_labels", cte("ratings") + "SELECT user_id, item_id, CASE WHEN rating > 3 THEN 1 ELSE 0 END "
       "AS label FROM ratings")
def _x7(f: Fx):
    """Like (1) for ratings above 3."""
    return f.ratings.select("user_id", "item_id", X.preference("rating").alias("label"))


@query("x8_x10_cosine_functions", cte("ratings", extra=_rating_sim_ctes("item", SIM_TOP, "it"))
       + "SELECT item1, item2, round(score, 6) AS cosine, round(2*(1 - score), 6) AS distance, "
         "round(1 - (2*(1 - score))/2, 6) AS weight FROM itsim")
def _x8(f: Fx):
    """X8 + X9 + X10: cosine, cosine distance and the weight 1 - d/2."""
    s = rating_similarity(f.ratings, "item", top_k=SIM_TOP)
    d = X.cosine_distance("score")
    return s.select("item1", "item2", F.col("score").alias("cosine"), d.alias("distance"),
                    X.distance_to_weight(d).alias("weight"))


@query("o2_best_sellers", cte("purchases_fine") + "SELECT item_id, count(*) AS purchases, "
       "row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM purchases_fine "
       "WHERE tier = 'history' GROUP BY item_id ORDER BY purchases DESC, item_id LIMIT 10")
def _o2(f: Fx):
    """O2: the ten best sellers of the history tier."""
    return PO.best_sellers(f.purchases_fine.filter(F.col("tier") == "history"), 10)


@query("w3_popularity_percent_ranks", cte("purchases_fine") + f"SELECT item_id, purchases, rank, "
       f"round(100.0*(rank - 1)/{POP_TOP}, 6) AS pct FROM (SELECT item_id, count(*) AS purchases, "
       f"row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM purchases_fine "
       f"WHERE tier = 'history' GROUP BY item_id) WHERE rank <= {POP_TOP}")
def _w3(f: Fx):
    """Top-100 best sellers mapped to percent ranks 0..99."""
    return PO.popularity_percent_ranks(f.purchases_fine.filter(F.col("tier") == "history"), POP_TOP)


@query("w4_nth_best_seller", cte("purchases_fine") + "SELECT item_id, purchases FROM (SELECT item_id, "
       "count(*) AS purchases, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM purchases_fine "
       "WHERE tier = 'history' GROUP BY item_id) WHERE rank = 101")
def _w4(f: Fx):
    """The 101st best seller (the printed count threshold)."""
    return PO.nth_best_seller(f.purchases_fine.filter(F.col("tier") == "history"), 101)


@query("w2_percent_rank", cte("ratings") + "SELECT user_id, item_id, round(100.0*(row_number() OVER "
       "(PARTITION BY user_id ORDER BY rating DESC, item_id) - 1) / count(*) OVER (PARTITION BY user_id), 6) AS pct, "
       "round(CASE WHEN count(*) OVER (PARTITION BY user_id) <= 1 THEN 0.0 ELSE 100.0*(row_number() OVER "
       "(PARTITION BY user_id ORDER BY rating DESC, item_id) - 1) / (count(*) OVER (PARTITION BY user_id) - 1) END, 6) "
       "AS pct_inclusive FROM ratings")
def _w2(f: Fx):
    """W2 + W2b: percent rank of each rating among the user's ratings
    (highest first, ties by item), both conventions; skew-safe ranking."""
    r = rank_in_group(f.ratings, "user_id", [F.col("rating").desc(), F.col("item_id").asc()], "pos", "n_user")
    return r.select("user_id", "item_id", X.percent_rank_expr("pos", "n_user").alias("pct"),
                    X.percent_rank_expr("pos", "n_user", inclusive=True).alias("pct_inclusive"))


def _fine_inter(f: Fx):
    return IN.build_interactions(f.purchases_fine)


_FINE_SPLIT = [("tr", f"SELECT * FROM inter WHERE {_bucket(0)} < 60"),
               ("te", f"SELECT * FROM inter WHERE {_bucket(0)} >= 80")]


@query("a15_popularity_mpr", cte("purchases_fine", extra=_inter_ctes("purchases_fine") + _FINE_SPLIT + [
    ("rk", f"SELECT item_id, 100.0*(rank - 1)/{POP_TOP} AS pct FROM (SELECT item_id, row_number() OVER "
           f"(ORDER BY count(*) DESC, item_id) AS rank FROM purchases_fine WHERE tier = 'history' GROUP BY item_id) "
           f"WHERE rank <= {POP_TOP}")])
    + "SELECT round(sum(te.rating*rk.pct)/sum(te.rating), 6) AS mpr, round(sum(te.rating), 6) AS sum_rating, "
      "count(*) AS n_rows FROM te JOIN rk USING (item_id)")
def _a15(f: Fx):
    """A15 + F9 + M18: popularity-baseline MPR on the 20% test split,
    restricted to the top-100 items."""
    _, _, test = IN.split3(_fine_inter(f), 0)
    ranks = PO.popularity_percent_ranks(f.purchases_fine.filter(F.col("tier") == "history"), POP_TOP)
    return PO.popularity_mpr(test, ranks)


@query("a14_mpr_popularity_scores", cte("purchases_fine", extra=_inter_ctes("purchases_fine") + _FINE_SPLIT + [
    ("pop", "SELECT item_id, sum(rating) AS pred FROM tr GROUP BY item_id"),
    ("sc", "SELECT te.user_id, te.item_id, te.rating, pop.pred FROM te JOIN pop USING (item_id)"),
    ("pr", "SELECT *, 100.0*(row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, item_id) - 1) "
           "/ count(*) OVER (PARTITION BY user_id) AS pct FROM sc")])
    + "SELECT round(sum(rating*pct)/(SELECT sum(rating) FROM te), 6) AS mpr, round(sum(rating), 6) AS den_joined, "
      "count(*) AS n_joined, round((SELECT sum(rating) FROM te), 6) AS den_all, "
      "(SELECT count(*) FROM te) AS n_all FROM pr")
def _a14(f: Fx):
    """A14 + W2 + J4 + D14: MPR of a train-popularity score on the test
    split; the denominator counts every test row (cold-start rows too).  The
    reference's per-user list (A17) is replaced by the skew-safe rank."""
    train, _, test = IN.split3(_fine_inter(f), 0)
    pop = train.groupBy("item_id").agg(F.sum("rating").alias("pred"))
    scored = test.join(pop, "item_id")
    return EV.mpr(scored, held_out=test, denominator="all")


# ---------------------------------------------------------------------------
# Q: serving

GUEST_BASE = 1_000_000_000_000  # ids above it are not registered users


@query("q1_recommend_for_users", cte("catalog", "ratings", "users", extra=_M5_CTES + [
    ("req", f"SELECT id FROM users UNION ALL SELECT {GUEST_BASE} + s_suppkey FROM supplier"),
    ("rec", f"SELECT user_id, item_id, pred AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
            f"ORDER BY round(pred, 9) DESC, item_id) AS rank FROM (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 "
            f"FROM ratings r WHERE r.user_id = p.user_id AND r.item_id = p.item_id))) WHERE rank <= {SERVE_N}"),
    ("best", f"SELECT id AS item_id, average_rating AS score, row_number() OVER (ORDER BY average_rating DESC, id) "
             f"AS rank FROM catalog WHERE number_of_ratings > {MIN_SUPPORT} ORDER BY rank LIMIT {SERVE_N}")])
    + "SELECT u.id AS user_id, rec.item_id, round(rec.score, 6) AS score, rec.rank, 'personal' AS source "
      "FROM req u JOIN rec ON rec.user_id = u.id "
      "UNION ALL SELECT u.id, best.item_id, round(best.score, 6), best.rank, 'popular' FROM req u, best "
      "WHERE u.id NOT IN (SELECT DISTINCT user_id FROM p WHERE NOT EXISTS (SELECT 1 FROM ratings r "
      "WHERE r.user_id = p.user_id AND r.item_id = p.item_id))")
def _q1(f: Fx):
    """Q1 + J13 + S10: top-10 for every registered user and as many unknown ids
    as there are suppliers: rows of the stored item-kNN table (S9), or the
    best-rated list for ids without any."""
    best = PO.best_rated(f.catalog, MIN_SUPPORT, SERVE_N)
    guests = f.t.supplier.select((F.col("s_suppkey") + F.lit(GUEST_BASE)).alias("user_id"))
    req = f.users.select(F.col("id").alias("user_id")).unionByName(guests)
    return serve.recommend_for_users(req, _user_reco_table(f), best, SERVE_N)


@query("q2_similar_items", cte("catalog", "ratings", extra=_content_ctes(SIM_TOP) + [
    ("top", "SELECT user_id FROM ratings GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1")])
    + "SELECT csim.item1, csim.item2, round(csim.score, 6) AS score, csim.rank FROM csim "
      "WHERE csim.item1 IN (SELECT item_id FROM ratings JOIN top USING (user_id))")
def _q2(f: Fx):
    """Q2 + S10: top-10 similar items for every item the most active user
    rated (a data-derived request batch) from the content similarity table."""
    sim = content_similarity(f.catalog, top_k=SIM_TOP)
    who = A.most_active(f.ratings).select("user_id")
    req = f.ratings.join(who, "user_id").select(F.col("item_id").alias("item1"))
    return serve.similar_items(req, sim, SIM_TOP)


@query("q3_user_history", cte("ratings", "users", extra=[
    ("top", "SELECT user_id FROM ratings GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1")])
    + "SELECT r.user_id, r.item_id, r.rating, CAST(r.rated_at AS VARCHAR) AS rated_at, u.first_name, u.last_name, "
      "u.email FROM ratings r JOIN top USING (user_id) LEFT JOIN users u ON u.id = r.user_id")
def _q3(f: Fx):
    """Q3 + A6 + F6: the most active user's rating history with profile."""
    h = serve.user_history(f.ratings, f.users)
    return h.select("user_id", "item_id", "rating",
                    F.date_format("rated_at", "yyyy-MM-dd HH:mm:ss").alias("rated_at"),
                    "first_name", "last_name", "email")


@query("flagship_similar_items_by_ratings", cte("ratings", extra=_rating_sim_ctes("item", SIM_TOP, "it") + [
    ("top", "SELECT user_id FROM ratings GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1")])
    + "SELECT item1, item2, round(score, 6) AS score, rank FROM itsim "
      "WHERE item1 IN (SELECT item_id FROM ratings JOIN top USING (user_id))")
def _flag(f: Fx):
    """Flagship: ratings fixture -> K2 top 10 -> Q2 for
    the items the most active user rated."""
    sim = rating_similarity(f.ratings, "item", top_k=SIM_TOP)
    who = A.most_active(f.ratings).select("user_id")
    req = f.ratings.join(who, "user_id").select(F.col("item_id").alias("item1"))
    return serve.similar_items(req, sim, SIM_TOP)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["flagship_similar_items_by_ratings"](spark, sf)


@query("s8_similarity_table", cte("catalog", extra=_content_ctes(SIM_TOP))
       + "SELECT item1, item2, round(score, 6) AS score, rank FROM csim")
def _s8(f: Fx):
    """The content similarity table written whole (full refresh) and read
    back; lookups by item1 then order by the stored rank (D7)."""
    path = scratch_path(f.spark, "similarity")
    SK.write_table(content_similarity(f.catalog, top_k=SIM_TOP), path)
    return SK.read_back(f.spark, path)


def _user_reco_table(f: Fx) -> DataFrame:
    path = scratch_path(f.spark, "users-reco")
    SK.write_table(_knn_recs(f, "item"), path)
    return SK.read_back(f.spark, path)


@query("s9_user_reco_table", cte("ratings", extra=_M5_CTES) + _recs_sql(RECO_TOP_RATING))
def _s9(f: Fx):
    """The per-user top-50 recommendation table (item kNN) written whole
    and read back."""
    return _user_reco_table(f)


@query("s9_content_reco_table", cte("catalog", "ratings", extra=_M4_CTES) + _recs_sql(RECO_TOP_CONTENT))
def _s9c(f: Fx):
    """The per-user top-30 content table written whole and read back."""
    path = scratch_path(f.spark, "users-content-reco")
    nb, by = NB.neighbors_for("content", f.ratings_once, f.catalog, CONTENT_K)
    SK.write_table(NB.knn_recommendations(nb, f.ratings_once, by, RECO_TOP_CONTENT), path)
    return SK.read_back(f.spark, path)


@query("s10_lookup_top_user", cte("ratings", extra=_M5_CTES + [
    ("top", "SELECT user_id FROM ratings GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1"),
    ("recs", _recs_sql(RECO_TOP_RATING))])
    + f"SELECT recs.* FROM recs JOIN top USING (user_id) WHERE rank <= {SERVE_N}")
def _s10(f: Fx):
    """S10 + F6 + O5: point read of the stored recommendation table for one
    user (the most active one), filter on a bound literal, ordered by rank,
    first 10."""
    table = _user_reco_table(f)
    uid = A.most_active(f.ratings).first()["user_id"]  # one scalar
    return SK.lookup(table, "user_id", int(uid), SERVE_N)


_M6B_CTES = _rating_sim_ctes("user", 1_000_000_000, "u") + [
    ("tri", "SELECT s.user1 AS user_id, r.item_id, s.score, r.rating, row_number() OVER (PARTITION BY s.user1, "
            "r.item_id ORDER BY s.score DESC, s.user2) AS rn FROM usim s JOIN ratings r ON r.user_id = s.user2"),
    ("pa", f"SELECT user_id, item_id, sum(score*rating) AS num, sum(abs(score)) AS den FROM tri "
           f"WHERE rn <= {RATING_K} GROUP BY 1, 2"),
    ("p", "SELECT user_id, item_id, num/den AS pred FROM pa WHERE num > 0")]


@query("m6b_user_knn_rated_recs", cte("ratings", extra=_M6B_CTES) + _recs_sql(RECO_TOP_RATING))
def _m6b(f: Fx):
    """User kNN, k=10 nearest users *who rated the item*, top 50 unseen
    items per user."""
    return NB.user_knn_rated_recommendations(f.ratings, RATING_K, RECO_TOP_RATING)


@query("m6b_user_knn_rated_mae", cte("ratings", extra=_M6B_CTES) + _MAE_SQL)
def _m6be(f: Fx):
    """M6b + J9 + A12."""
    return NB.user_knn_rated_mae(f.ratings, RATING_K)


@query("s3_brands_scan", cte("brands") + "SELECT id, name, origin_id FROM brands")
def _s3b(f: Fx):
    """S3: all brands (dimension scan)."""
    return fx.brands(f.t).select("id", "name", "origin_id")


@query("s3_flavors_scan", cte("flavors") + "SELECT id, name FROM flavors")
def _s3f(f: Fx):
    """S3: all flavors (dimension scan)."""
    return fx.flavors(f.t).select("id", "name")


# ---------------------------------------------------------------------------
# Exact twins of steps that follow a fitted model, on given inputs: scores and
# coefficients come from the tables by the split hash, in 1024ths, so that
# products are exact in both engines.

GIVEN = 1024


def _given(cols: list, seed: int):
    return X.hash_bucket(cols, seed, GIVEN) / F.lit(float(GIVEN))


def _given_sql(seed: int, *cols: str) -> str:
    return f"({_bucket(seed, GIVEN, cols)} / {GIVEN}.0)"


@query("a20_pooled_accuracy", cte("ratings") + "SELECT round(avg(CASE WHEN (rating > 3) = "
       f"({_given_sql(11, 'user_id', 'item_id')} >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_rows FROM ratings")
def _a20(f: Fx):
    """Pooled accuracy of given class predictions."""
    p = f.ratings.select(X.preference("rating").alias("label"),
                         (_given(["user_id", "item_id"], 11) >= 0.5).cast("int").alias("prediction"))
    return EV.accuracy(p)


_RUNS_SQL = [("sc", f"SELECT user_id % 3 AS rank, item_id % 4 AS reg, {_bucket(12, 10)} AS run, rating, "
                    f"5 * {_given_sql(13, 'user_id', 'item_id')} AS pred FROM ratings"),
             ("res", "SELECT rank, reg, run, sqrt(avg((rating - pred)*(rating - pred))) AS rmse, avg(abs(rating - pred)) AS mae "
                     "FROM sc GROUP BY 1, 2, 3"),
             ("av", "SELECT rank, reg, avg(rmse) AS rmse, avg(mae) AS mae, count(*) AS n_runs FROM res GROUP BY 1, 2"),
             ("bp", "SELECT rank, reg FROM av ORDER BY rmse, rank, reg LIMIT 1")]


@query("a21_a22_grid_average_best", cte("ratings", extra=_RUNS_SQL) + "SELECT av.rank, av.reg, round(rmse, 6) AS rmse, "
       "round(mae, 6) AS mae, n_runs, bp.rank IS NOT NULL AS best FROM av LEFT JOIN bp ON av.rank = bp.rank AND av.reg = bp.reg")
def _a21(f: Fx):
    """A21 + A22: errors of given predictions per point and run, their means
    per point, and the best point."""
    s = f.ratings.select((F.col("user_id") % 3).alias("rank"), (F.col("item_id") % 4).alias("reg"),
                         X.hash_bucket(["user_id", "item_id"], 12, 10).alias("run"), "rating",
                         (5 * _given(["user_id", "item_id"], 13)).alias("pred"))
    res = s.groupBy("rank", "reg", "run").agg(F.sqrt(F.avg(X.squared_error("rating", "pred"))).alias("rmse"),
                                              F.avg(X.abs_error("rating", "pred")).alias("mae"))
    avg = EV.average_by_point(res, ["rank", "reg"], ["rmse", "mae"])
    best = EV.best_point(avg, "rmse", ["rank", "reg"]).select("rank", "reg", F.lit(True).alias("best"))
    return avg.join(best, ["rank", "reg"], "left").withColumn("best", F.coalesce("best", F.lit(False)))


@query("f7_pca_input", cte("catalog") + "SELECT id, country, flavor, style, number_of_ratings, "
       "round(average_aroma_rating, 6) AS average_aroma_rating, round(average_appearance_rating, 6) AS average_appearance_rating, "
       "round(average_taste_rating, 6) AS average_taste_rating, round(average_body_rating, 6) AS average_body_rating FROM catalog")
def _f7(f: Fx):
    """the catalog without the average rating (the id stays as row key)."""
    return FE.drop_for_pca(f.catalog)


_COV_DIMS = (" UNION ALL ".join(f"SELECT id, '{c}' AS dim, CAST(coalesce({c}, 0) AS DOUBLE) AS v FROM catalog" for c in _Z)
             + "".join(f" UNION ALL SELECT id, '{c}_' || coalesce({c}, '0'), 1.0 FROM catalog" for c in FE.CATEGORY_FEATURES))


@query("e8_covariance", cte("catalog", extra=[
    ("lv", _COV_DIMS), ("nn", "SELECT count(*) AS n FROM catalog"), ("mu", "SELECT dim, sum(v) AS s FROM lv GROUP BY dim"),
    ("pr", "SELECT a.dim AS dim1, b.dim AS dim2, sum(a.v*b.v) AS s FROM lv a JOIN lv b ON a.id = b.id GROUP BY 1, 2")])
    + "SELECT m1.dim AS dim1, m2.dim AS dim2, round((coalesce(pr.s, 0) - m1.s*m2.s/n)/(n - 1), 6) AS cov "
      "FROM mu m1 CROSS JOIN mu m2 CROSS JOIN nn LEFT JOIN pr ON pr.dim1 = m1.dim AND pr.dim2 = m2.dim "
      "WHERE coalesce(pr.s, 0) <> 0")
def _e8c(f: Fx):
    """Covariance of the raw features and one-hot categories, for pairs of
    dimensions that occur together."""
    return FE.covariance_long(f.catalog)


@query("j12_training_rows", cte("catalog", "ratings", extra=_content_ctes(1)[:4] + [
    ("bu", f"SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) > {BAND_LO} AND count(*) < {BAND_HI}")])
    + "SELECT r.user_id, r.item_id, CASE WHEN r.rating > 3 THEN 1 ELSE 0 END AS label, "
    + ", ".join(f"round(z{i}/sqrt(nn), 6) AS x{i}" for i in range(5))
    + " FROM ratings r JOIN bu USING (user_id) JOIN czn ON czn.id = r.item_id")
def _j12(f: Fx):
    """J12 + X7 + F12: labelled rows of the activity band with the item's unit
    content vector (its numeric part shown)."""
    from pyspark.ml.functions import vector_to_array
    from reco.operators.classify import band_users, training_rows
    t = training_rows(f.ratings_once, f.catalog, band_users(f.ratings_once, BAND_LO, BAND_HI))
    x = vector_to_array("x")
    return t.select("user_id", "item_id", "label", *[x[i].alias(f"x{i}") for i in range(5)])


_K5_DIMS = (" UNION ALL ".join(f"SELECT id, {i} AS j, z{i}/sqrt(nn) AS v FROM czn" for i in range(5))
            + " UNION ALL SELECT id, 4 + ci, 1/sqrt(nn) FROM ix"
              " UNION ALL SELECT id, 4 + nc + 1 + fi, 1/sqrt(nn) FROM ix"
              " UNION ALL SELECT id, 4 + nc + 1 + nf + 1 + si, 1/sqrt(nn) FROM ix")


@query("k5_affinity_given_coefficients", cte("catalog", "ratings", extra=_content_ctes(1)[:4] + [
    ("ix", "SELECT id, nn, dense_rank() OVER (ORDER BY country) AS ci, dense_rank() OVER (ORDER BY flavor) AS fi, "
           "dense_rank() OVER (ORDER BY style) AS si, (SELECT count(DISTINCT country) FROM czn) AS nc, "
           "(SELECT count(DISTINCT flavor) FROM czn) AS nf FROM czn"),
    ("iv", _K5_DIMS)])
    + f"SELECT r.user_id, r.item_id, round(2*(1 - sum(iv.v * {_given_sql(14, 'r.user_id', 'iv.j')})), 6) AS affinity "
      "FROM ratings r JOIN iv ON iv.id = r.item_id GROUP BY 1, 2")
def _k5g(f: Fx):
    """K5: affinity 2(1 - x.coef) of every rated pair for given coefficients."""
    from reco.operators.classify import item_feature_vectors, user_item_affinity
    iv = item_feature_vectors(f.catalog)
    dim = len(iv.first()["x"])
    users = f.ratings_once.select("user_id").distinct()
    coefs = users.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(dim - 1)))).select(
        "user_id", "j", _given(["user_id", "j"], 14).alias("coef"))
    return user_item_affinity(coefs, iv, f.ratings_once.select("user_id", "item_id"))


_FACTORS = 3


@query("m10_top_unseen_given_factors", cte("ratings", "titles", extra=[
    ("cn", "SELECT item_id, count(*) AS c FROM ratings GROUP BY item_id HAVING count(*) > 1"),
    ("us", "SELECT DISTINCT user_id FROM ratings"),
    ("pr", "SELECT us.user_id, cn.item_id, cn.c, "
           + " + ".join(f"{_given_sql(20 + k, 'us.user_id')} * {_given_sql(30 + k, 'cn.item_id')}" for k in range(_FACTORS))
           + " AS p FROM us CROSS JOIN cn WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = us.user_id "
             "AND r.item_id = cn.item_id)"),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, item_id) AS rank FROM pr")])
    + "SELECT rk.user_id, rk.item_id, t.title, rk.c AS count, round(rk.p, 6) AS pred_rating, rk.rank "
      "FROM rk LEFT JOIN titles t USING (item_id) WHERE rk.rank <= 50")
def _m10g(f: Fx):
    """M10 + J8 + F10 + O4 + J10 on given factors: top-50 unseen items with more
    than one rating, with title and rating count."""
    from reco.operators import factorization as FA

    def factors(col: str, seed: int) -> DataFrame:
        return f.ratings_once.select(F.col(col).alias("id")).distinct().select(
            "id", F.array(*[_given(["id"], seed + k) for k in range(_FACTORS)]).alias("v"))

    return FA.top_unseen_by_factors(factors("user_id", 20), factors("item_id", 30), f.ratings_once, f.titles, 50, 1)
