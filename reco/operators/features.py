"""Feature engineering.

Content vectors are kept as *scalar columns* (five z-scores plus the three
category strings) so that no data-dependent schema appears; the one-hot form
is available in long (id, dim, value) layout.  Rating vectors are long
(entity, dim, value) frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reco.functions.columns import cosine, cosine_distance

NUMERIC_FEATURES = ["number_of_ratings", "average_aroma_rating", "average_appearance_rating",
                    "average_taste_rating", "average_body_rating"]
CATEGORY_FEATURES = ["country", "flavor", "style"]
Z_COLS = [f"z_{c}" for c in NUMERIC_FEATURES]


def fill_missing(df: DataFrame, value: int = 0) -> DataFrame:
    """F8 / D3: fill numeric nulls with 0 and string nulls with "0" (missing
    flavor/style becomes its own category, as the reference's fillna does)."""
    return df.na.fill(value).na.fill(str(value))


def one_hot_long(df: DataFrame, id_col: str, cat_cols: list[str]) -> DataFrame:
    """One row (id, "col_value", 1.0) per category value (long one-hot)."""
    parts = [F.struct(F.concat(F.lit(f"{c}_"), F.col(c).cast("string")).alias("dim"),
                      F.lit(1.0).alias("value")) for c in cat_cols]
    x = df.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("_f"))
    return x.filter(F.col("_f.dim").isNotNull()).select("id", "_f.dim", "_f.value")


def feature_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample std of each column: one aggregate row of 2*len(cols)
    numbers (bounded by the column count, not by the data).  An empty column
    or one with a single row has mean 0 or std 0."""
    row = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"),
                                             F.stddev_samp(c).alias(f"s_{c}"))]).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0)) for c in cols}


def standardize(df: DataFrame, cols: list[str], stats: dict | None = None,
                prefix: str = "z_") -> DataFrame:
    """Z-score each column with the sample std (ddof=1).  A column without
    spread has z = 0."""
    stats = stats or feature_stats(df, cols)

    def z(c: str):
        mean, sd = stats[c]
        return ((F.col(c) - F.lit(mean)) / F.lit(sd) if sd else F.lit(0.0)).alias(prefix + c)

    return df.select("*", *[z(c) for c in cols])


def content_features(catalog: DataFrame, missing_as_category: bool = True) -> DataFrame:
    """E4 (scalar form): id, five z-scores, three category strings.

    The L2 normalisation (E3) is folded into the similarity kernel, which
    divides the dot product by both norms."""
    from reco.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(catalog.sparkSession)
    c = fill_missing(catalog) if missing_as_category else catalog.na.fill(0)
    # item-level table (one row per item): materialise it once so the
    # statistics pass and the later scoring do not re-aggregate the fact table
    c = c.select("id", *NUMERIC_FEATURES, *CATEGORY_FEATURES).checkpoint(eager=True)
    z = standardize(c, NUMERIC_FEATURES)
    return z.select("id", *Z_COLS, *CATEGORY_FEATURES)


def content_vectors_long(catalog: DataFrame, missing_as_category: bool = True) -> DataFrame:
    """E4 (long form) = E2 + E1 then E3: (id, dim, value) of unit vectors."""
    f = content_features(catalog, missing_as_category)
    num = f.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(z).alias("value"))
                                             for c, z in zip(NUMERIC_FEATURES, Z_COLS)])).alias("_f"))
    num = num.select("id", "_f.dim", "_f.value")
    long = num.unionByName(one_hot_long(f, "id", CATEGORY_FEATURES))
    return l2_normalize(long, "id", "value")


def l2_normalize(long_df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Divide each vector by its L2 norm (norm joined after aggregation).
    A zero vector has no direction and is dropped."""
    norms = (long_df.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
             .filter(F.col("_norm") > 0))
    return (long_df.join(norms, key)
            .withColumn(value, F.col(value) / F.col("_norm")).drop("_norm"))


def rating_vectors(ratings: DataFrame, entity: str = "item", center: bool = False,
                   normalize: bool = True) -> DataFrame:
    """E5 (entity="user": user vectors over items) / E6 (entity="item": item
    vectors over users).  Long form (id, dim, value); nulls dropped (D2).
    ``center`` subtracts the entity mean first (the commented-out variant)."""
    key, dim = ("user_id", "item_id") if entity == "user" else ("item_id", "user_id")
    r = (ratings.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
         .select(F.col(key).alias("id"), F.col(dim).alias("dim"), F.col("rating").cast("double").alias("value")))
    if center:
        m = r.groupBy("id").agg(F.avg("value").alias("_m"))
        r = r.join(m, "id").withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    return l2_normalize(r, "id") if normalize else r


def dense_index(df: DataFrame, col: str, alias: str = "idx") -> DataFrame:
    """Dense 0-based index of the distinct values of ``col`` in ascending
    order.  Distributed: range-partitioned sort plus per-partition offsets
    (``ranking.global_rank``), never a single-partition window."""
    from reco.operators.ranking import global_rank
    d = df.select(col).distinct()
    r = global_rank(d, [F.col(col).asc()], "_r")
    return r.select(col, (F.col("_r") - 1).cast("long").alias(alias))


def drop_for_pca(catalog: DataFrame) -> DataFrame:
    """drop id and average_rating (keep id aside as the row key)."""
    return catalog.drop("average_rating")


def pca_coordinates(catalog: DataFrame, k: int = 2):
    """PCA of raw (not z-scored) numeric features plus one-hot categories,
    centred first (sklearn centres in transform, Spark's PCA does not).

    Returns (coords DataFrame(id, pc1..pck), explained_variance list)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, PCA, StandardScaler, StringIndexer, VectorAssembler

    c = drop_for_pca(fill_missing(catalog))
    idx = [StringIndexer(inputCol=x, outputCol=f"{x}_idx", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for x in CATEGORY_FEATURES]
    ohe = OneHotEncoder(inputCols=[f"{x}_idx" for x in CATEGORY_FEATURES],
                        outputCols=[f"{x}_vec" for x in CATEGORY_FEATURES], dropLast=False)
    asm = VectorAssembler(inputCols=NUMERIC_FEATURES + [f"{x}_vec" for x in CATEGORY_FEATURES],
                          outputCol="features")
    center = StandardScaler(inputCol="features", outputCol="centered", withMean=True, withStd=False)
    pca = PCA(k=k, inputCol="centered", outputCol="pca")
    model = Pipeline(stages=[*idx, ohe, asm, center, pca]).fit(c)
    out = model.transform(c)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("pca")
    coords = out.select("id", *[arr[i].alias(f"pc{i + 1}") for i in range(k)])
    return coords, list(model.stages[-1].explainedVariance.toArray())


def covariance_long(catalog: DataFrame) -> DataFrame:
    """Sample covariance (dim1, dim2, cov) of the raw numeric features and
    one-hot categories, for pairs of dimensions with a non-zero product sum.
    An item has few non-zero dimensions, so the self-join on the id makes a
    bounded number of products an item, summed before the shuffle."""
    c = fill_missing(catalog)
    num = c.select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).cast("double").alias("value"))
                                             for x in NUMERIC_FEATURES])).alias("_f")).select("id", "_f.dim", "_f.value")
    v = num.unionByName(one_hot_long(c, "id", CATEGORY_FEATURES))
    n = c.count()
    sums = v.groupBy("dim").agg(F.sum("value").alias("s"))
    p = (v.select("id", F.col("dim").alias("dim1"), F.col("value").alias("a"))
         .join(v.select("id", F.col("dim").alias("dim2"), F.col("value").alias("b")), "id")
         .groupBy("dim1", "dim2").agg(F.sum(F.col("a") * F.col("b")).alias("p")).filter("p <> 0"))
    j = (p.join(sums.select(F.col("dim").alias("dim1"), F.col("s").alias("s1")), "dim1")
         .join(sums.select(F.col("dim").alias("dim2"), F.col("s").alias("s2")), "dim2"))
    return j.select("dim1", "dim2", ((F.col("p") - F.col("s1") * F.col("s2") / F.lit(n)) / F.lit(n - 1)).alias("cov"))


def pca_with_values(coords: DataFrame, values: DataFrame, on: str = "id") -> DataFrame:
    """PCA coordinates joined with a per-item value (rating, or distance
    to a reference item) -- the data behind the notebook's scatter plots."""
    return coords.join(values, on)


def distance_to_item(catalog: DataFrame, ref_id: int, missing_as_category: bool = True) -> DataFrame:
    """Cosine distance 2(1 - cos) of every item's content vector to one
    reference item (E9's colouring): the reference vector is one row used as
    literals in a column expression -- a single pass, no pairs."""
    f = content_features(catalog, missing_as_category)
    ref = f.filter(F.col("id") == F.lit(ref_id)).first()
    if ref is None:
        return f.select("id", F.lit(None).cast("double").alias("distance")).limit(0)
    dot = sum((F.col(z) * F.lit(float(ref[z])) for z in Z_COLS), F.lit(0.0))
    for c in CATEGORY_FEATURES:
        dot = dot + F.when(F.col(c) == F.lit(ref[c]), 1.0).otherwise(0.0) if ref[c] is not None else dot
    n_ref = sum(float(ref[z]) ** 2 for z in Z_COLS) + sum(1 for c in CATEGORY_FEATURES if ref[c] is not None)
    nn = sum((F.col(z) * F.col(z) for z in Z_COLS), F.lit(0.0))
    for c in CATEGORY_FEATURES:
        nn = nn + F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    return f.select("id", cosine_distance(cosine(dot, nn, F.lit(n_ref))).alias("distance"))
