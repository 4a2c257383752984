"""Exact deduplication by full content, combined in three steps.

1. local: rows of equal (digest, salt, text) combine in each map task;
2. salted: the local winners of one salt of a digest meet in one reducer;
3. global: the salt winners of a digest meet, at most ``SALTS`` rows a text
   however many copies there are.

Every step groups by the text itself beside its SHA-256, so two texts that
shared a digest would stay apart.  The salt comes from the document id.  Ids
are matched to their group by the digest alone where the digest has one text,
and by digest and text where it has more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reco.llm.common import free_name, stored

SALTS = 64
EXPLODE = 4096  # rows one generated array makes


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"),
                       F.sha2(text.cast("binary"), 256).alias("digest"))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest, text, keep_id, size`` of each distinct text."""
    d = _keyed(docs, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    salted = (d.groupBy("digest", "salt", "text")
              .agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")))
    return (salted.repartition("digest").groupBy("digest", "text")
            .agg(F.max("top").alias("keep_id"), F.sum("n").alias("size")))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest, n_texts, keep_id, size``, one row per digest that more than
    one row has; texts with the digest to themselves are left out."""
    return (content_groups(docs, id_col, text_col).groupBy("digest")
            .agg(F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"),
                 F.sum("size").alias("size"))
            .filter(F.col("size") > 1))


def _repeats(docs: DataFrame, id_col: str, text_col: str) -> bool:
    """Whether some row repeats the id and the text of another."""
    rows = _keyed(docs, id_col, text_col).groupBy("id", "digest").agg(F.count(F.lit(1)).alias("c"))
    return bool(rows.filter(F.col("c") > 1).limit(1).count())


def _shared_digests(groups: DataFrame) -> bool:
    return bool(groups.filter(F.col("n_texts") > 1).limit(1).count())


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty.  The row with the largest id of equal texts
    stays; null ids are smaller than all others.  Of rows that repeat the
    largest id with the same text one is kept; every repeat has its row in the
    result.  An empty table gives an empty result.
    """
    groups = stored(copy_groups(docs, id_col, text_col), "copies")
    d = _keyed(docs, id_col, text_col)
    rows = d.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("c"))
    if _shared_digests(groups):  # a SHA-256 collision: the text decides
        texts = stored(content_groups(docs, id_col, text_col), "texts")
        j = (d.groupBy("id", "digest", "text").agg(F.count(F.lit(1)).alias("c"))
             .join(texts, ["digest", "text"]))
    else:
        j = rows.join(groups.select("digest", "keep_id", "size"), "digest", "left")
    j = j.select("id", "digest", "c", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                 F.coalesce("size", F.lit(1)).cast("long").alias("group_size"))
    # one output row per repeat, by two short generated arrays
    part = (j.withColumn("_a", F.explode(F.sequence(F.lit(0), F.expr(f"(c - 1) div {EXPLODE}"))))
            .withColumn("_b", F.explode(F.sequence(F.lit(0), F.least(F.lit(EXPLODE), F.col("c") - F.col("_a") * EXPLODE) - 1))))
    return part.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                       (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_a") == 0) & (F.col("_b") == 0)).alias("kept"),
                       F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts
    the row with the largest id (see ``decisions`` for nulls and repeats)."""
    cols = docs.columns
    dig, kid, size = (free_name(cols, n) for n in ("_digest", "_keep_id", "_size"))
    groups = stored(copy_groups(docs, id_col, text_col), "copies")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.withColumn(dig, F.sha2(text.cast("binary"), 256))
    if _shared_digests(groups):
        t = free_name(cols, "_text")
        texts = stored(content_groups(docs, id_col, text_col).filter(F.col("size") > 1), "texts")
        j = d.withColumn(t, text).join(
            texts.select(F.col("digest").alias(dig), F.col("text").alias(t), F.col("keep_id").alias(kid), F.col("size").alias(size))
            .hint("merge"), [dig, t], "left")
        same = [dig, t, id_col]
    else:
        j = d.join(groups.select(F.col("digest").alias(dig), F.col("keep_id").alias(kid), F.col("size").alias(size))
                   .hint("merge"), dig, "left")   # the groups grow with the input: never a broadcast
        same = [dig, id_col]
    out = [F.col(f"`{c}`") for c in cols]
    alone = F.col(size).isNull()
    top = F.col(size).isNotNull() & F.col(f"`{id_col}`").eqNullSafe(F.col(kid))
    if not _repeats(docs, id_col, text_col):
        return j.filter(alone | top).select(*out)
    tops = j.filter(top).repartition(*[F.col(f"`{c}`") for c in same]).dropDuplicates(same)
    return j.filter(alone).select(*out).unionByName(tops.select(*out))
