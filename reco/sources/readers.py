"""Sources.

Readers take DataFrames or any Hadoop-FS URI (``hdfs://``, ``s3a://``,
``file://``, S6) and always use explicit schemas -- no inference pass over the
data.  Filters and projections stay declarative so Catalyst pushes them into
the parquet/JDBC scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RATING_SCHEMA = T.StructType([T.StructField("user_id", T.IntegerType()),
                              T.StructField("item_id", T.IntegerType()),
                              T.StructField("rating", T.FloatType())])
PURCHASE_SCHEMA = T.StructType([T.StructField("user_id", T.StringType()),
                                T.StructField("item_id", T.StringType())])


def item_catalog(beers: DataFrame, brands: DataFrame, origins: DataFrame,
                 flavors: DataFrame, styles: DataFrame, min_ratings: int = 0) -> DataFrame:
    """S1 (+F1, F3, J1, J2): item ⋈ brand ⋈ origin, left ⋈ flavor, style;
    rated items only.  Dimension sides are small lookup tables; AQE turns the
    joins into broadcast hash joins from runtime sizes."""
    b = beers.filter(F.col("number_of_ratings") > min_ratings)
    br = brands.select(F.col("id").alias("_brand"), "origin_id")
    o = origins.select(F.col("id").alias("_origin"), F.col("name").alias("country"))
    f = flavors.select(F.col("id").alias("_flavor"), F.col("name").alias("flavor"))
    s = styles.select(F.col("id").alias("_style"), F.col("name").alias("style"))
    j = (b.join(br, b.brand_id == br._brand)
          .join(o, F.col("origin_id") == o._origin)
          .join(f, b.flavor_id == f._flavor, "left")
          .join(s, b.style_id == s._style, "left"))
    return j.select("id", "country", "flavor", "style", "average_rating", "number_of_ratings",
                    "average_aroma_rating", "average_appearance_rating", "average_taste_rating",
                    "average_body_rating")


def ratings_scan(ratings: DataFrame) -> DataFrame:
    """Keep rows where user OR item is present (the reference's
    predicate; half-null rows survive here and are dropped by model inputs, D2)."""
    return ratings.filter(F.col("user_id").isNotNull() | F.col("item_id").isNotNull())


def model_ratings(ratings: DataFrame) -> DataFrame:
    """Model inputs drop any row with a null key."""
    return ratings.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())


def user_profiles(users: DataFrame) -> DataFrame:
    """S3: user projection."""
    return users.select("id", "first_name", "last_name", "email")


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """S4 (+X1, X2): header-less ``user,item,rating`` lines, typed by schema."""
    return spark.read.schema(RATING_SCHEMA).option("header", False).csv(path)


def read_purchases_csv(spark: SparkSession, path: str, drop_header_twins: bool = False) -> DataFrame:
    """Header CSV of purchases (first two columns used, extra columns
    ignored).  ``drop_header_twins`` reproduces the reference's header removal,
    which also drops every data line equal to the header."""
    if not drop_header_twins:
        df = spark.read.schema(PURCHASE_SCHEMA).option("header", True).csv(path)
        return df
    lines = spark.read.text(path)
    # the first line of the first input partition (what a `take(1)` returns):
    # the smallest monotonically increasing id, then drop every equal line
    first = (lines.select("value", F.monotonically_increasing_id().alias("_pos"))
             .orderBy("_pos").limit(1).select("value"))
    body = lines.join(F.broadcast(first), "value", "left_anti")  # one row
    parts = F.split(F.col("value"), ",")
    return body.select(parts.getItem(0).alias("user_id"), parts.getItem(1).alias("item_id"))


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Temp view + SQL text over it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)
