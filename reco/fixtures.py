"""Fixture views over the driver tables (see FIXTURES.md).

Each fixture exists twice: as a lazy DataFrame built from the parquet tables
(used by the Spark jobs) and as DuckDB SQL text (used as a CTE by the oracle
queries).  Both spell out the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reco.operators.aggregates import latest_per_key
from reco.tables import Tables

# Flavor ids by part type, as bound in FIXTURES.md.
FLAVOR_IDS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
# Recency tier boundaries of the purchase fixture.
TIER_RECENT_FROM = "1998-01-01"
TIER_MORE_RECENT_FROM = "2000-01-01"


def _brand_id(col: str = "p_brand"):
    return F.expr(f"substr({col}, 7)").cast("int")


def ratings_raw(t: Tables, with_order_key: bool = False) -> DataFrame:
    """Every (customer, part) line as a rating event; duplicates kept."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    cols = [F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
            F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
            F.col("o_orderdate").alias("rated_at")]
    if with_order_key:
        cols += ["l_orderkey", "l_linenumber", "l_quantity"]
    return j.select(*cols)


def ratings(t: Tables) -> DataFrame:
    """Last rating per (user, item) by (date, order, line, quantity)."""
    raw = ratings_raw(t, with_order_key=True)
    return latest_per_key(raw, ["user_id", "item_id"], ["rating", "rated_at"],
                          ["rated_at", "l_orderkey", "l_linenumber", "l_quantity"])


def brands(t: Tables) -> DataFrame:
    p = t.part.select("p_brand").distinct()
    return p.select(_brand_id().alias("id"), F.col("p_brand").alias("name"),
                    (_brand_id() - 1).alias("origin_id"))


def origins(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def flavors(t: Tables) -> DataFrame:
    # The distinct type set is bounded by the number of part types, so the
    # un-partitioned window below sees a handful of rows.
    from pyspark.sql import Window
    d = t.part.select("p_type").distinct()
    return d.select(F.row_number().over(Window.orderBy("p_type")).alias("id"),
                    F.col("p_type").alias("name"))


def styles(t: Tables) -> DataFrame:
    return (t.part.select("p_size").distinct()
            .select(F.col("p_size").alias("id"),
                    F.concat(F.lit("STYLE_"), F.col("p_size").cast("string")).alias("name")))


def beers(t: Tables) -> DataFrame:
    """Item source table; the rating statistics are aggregated per part before
    the (1:1) left join, so the join never sees lineitem rows."""
    li = (t.lineitem
          .groupBy("l_partkey")
          .agg(F.avg(F.ceil(F.col("l_quantity") / 10).cast("double")).alias("average_rating"),
               F.count("l_partkey").alias("number_of_ratings"),
               F.avg(1 + 40 * F.col("l_discount")).alias("average_aroma_rating"),
               F.avg(1 + F.col("l_quantity") / 12.5).alias("average_appearance_rating"),
               F.avg(F.col("l_linenumber").cast("double")).alias("average_taste_rating")))
    flavor = F.lit(None).cast("int")
    for name, fid in FLAVOR_IDS.items():
        flavor = F.when(F.col("p_type") == name, F.lit(fid)).otherwise(flavor)
    p = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    j = p.join(li, p.p_partkey == li.l_partkey, "left")
    return j.select(
        F.col("p_partkey").alias("id"), _brand_id().alias("brand_id"),
        flavor.alias("flavor_id"), F.col("p_size").alias("style_id"),
        "average_rating",
        F.coalesce(F.col("number_of_ratings"), F.lit(0)).alias("number_of_ratings"),
        "average_aroma_rating", "average_appearance_rating", "average_taste_rating",
        (F.col("p_size").cast("double") / 10).alias("average_body_rating"))


def users(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("first_name"),
                             F.col("c_mktsegment").alias("last_name"),
                             F.concat("c_name", F.lit("@example.com")).alias("email"))


def titles(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


def _purchase_lines(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def _tier():
    d = F.col("o_orderdate")
    return (F.when(d < F.lit(TIER_RECENT_FROM).cast("timestamp"), "history")
            .when(d < F.lit(TIER_MORE_RECENT_FROM).cast("timestamp"), "recent")
            .otherwise("more_recent"))


def purchases(t: Tables) -> DataFrame:
    j = _purchase_lines(t)
    p = t.part.select("p_partkey", "p_brand")
    j = j.join(p, j.l_partkey == p.p_partkey)
    return j.select(F.col("o_custkey").alias("user_id"), _brand_id().alias("item_id"),
                    _tier().alias("tier"))


def purchases_fine(t: Tables) -> DataFrame:
    j = _purchase_lines(t)
    return j.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                    _tier().alias("tier"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                               "label")


# ---------------------------------------------------------------------------
# The same fixtures as DuckDB SQL (CTE bodies), with their dependencies.

FIXTURE_SQL: dict[str, str] = {
    "ratings_raw": """
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(ceil(l_quantity/10) AS DOUBLE) AS rating, o_orderdate AS rated_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": """
  SELECT user_id, item_id, rating, rated_at FROM (
    SELECT o_custkey AS user_id, l_partkey AS item_id,
           CAST(ceil(l_quantity/10) AS DOUBLE) AS rating, o_orderdate AS rated_at,
           row_number() OVER (PARTITION BY o_custkey, l_partkey
             ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t
  WHERE rn = 1""",
    "brands": """
  SELECT DISTINCT CAST(substr(p_brand,7) AS INT) AS id, p_brand AS name,
         CAST(substr(p_brand,7) AS INT) - 1 AS origin_id FROM part""",
    "origins": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "flavors": """
  SELECT CAST(row_number() OVER (ORDER BY p_type) AS INT) AS id, p_type AS name
  FROM (SELECT DISTINCT p_type FROM part) t""",
    "styles": """
  SELECT DISTINCT p_size AS id, concat('STYLE_', CAST(p_size AS VARCHAR)) AS name
  FROM part""",
    "beers": """
  SELECT p_partkey AS id, CAST(substr(p_brand,7) AS INT) AS brand_id,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                     WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS flavor_id,
         p_size AS style_id,
         avg(ceil(l_quantity/10)) AS average_rating,
         count(l_partkey) AS number_of_ratings,
         avg(1 + 40*l_discount) AS average_aroma_rating,
         avg(1 + l_quantity/12.5) AS average_appearance_rating,
         avg(CAST(l_linenumber AS DOUBLE)) AS average_taste_rating,
         CAST(p_size AS DOUBLE)/10 AS average_body_rating
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey
  GROUP BY p_partkey, p_brand, p_type, p_size""",
    "users": """
  SELECT c_custkey AS id, c_name AS first_name, c_mktsegment AS last_name,
         concat(c_name, '@example.com') AS email FROM customer""",
    "titles": "SELECT p_partkey AS item_id, p_name AS title FROM part",
    "purchases": """
  SELECT o_custkey AS user_id, CAST(substr(p_brand,7) AS INT) AS item_id,
         CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'history'
              WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'recent'
              ELSE 'more_recent' END AS tier
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "purchases_fine": """
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'history'
              WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'recent'
              ELSE 'more_recent' END AS tier
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
    # The item catalog (star join, rated items only)
    "catalog": """
  SELECT b.id, o.name AS country, f.name AS flavor, s.name AS style,
         b.average_rating, b.number_of_ratings, b.average_aroma_rating,
         b.average_appearance_rating, b.average_taste_rating, b.average_body_rating
  FROM beers b JOIN brands br ON b.brand_id = br.id
       JOIN origins o ON br.origin_id = o.id
       LEFT JOIN flavors f ON b.flavor_id = f.id
       LEFT JOIN styles s ON b.style_id = s.id
  WHERE b.number_of_ratings > 0""",
}

FIXTURE_DEPS: dict[str, tuple[str, ...]] = {
    "catalog": ("beers", "brands", "origins", "flavors", "styles"),
}


def cte(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named fixtures (dependencies first), then
    any ``extra`` (name, sql) pairs in the given order."""
    order: list[str] = []

    def add(n: str):
        for d in FIXTURE_DEPS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in order]
    parts += [f"{n} AS ({s}\n)" for n, s in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
