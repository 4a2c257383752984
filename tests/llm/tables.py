"""Small tables with the awkward cases: nulls in every column, empty and long
texts, ties, repeated rows, extra columns whose names clash with working names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"

LONG = "word other thing\n" * 90_000       # over the piece length of the encoders
EN = "The cat sat on the mat and the dog ran after it. It was the end of the day."
FR = "Le chat est sur la table et le chien court. Il est tard pour la famille."

DOC_ROWS = [
    (1, EN, "en", "b", 1), (2, EN, "en", "a", 1), (3, FR, "fr", None, 1), (4, "", "en", "a", 0), (5, None, None, "a", None),
    (6, "12 34 -- !!", None, "a", 3), (7, LONG, "en", "c", 9), (None, EN, None, None, None), (None, None, None, None, None),
    (8, EN, "en", "b", 1), (8, EN, "en", "b", 1), (8, "another text of the same id", "en", "b", 1),
    (9, "  lead\t\ttabs \n\n and  spaces\r\n end  ", "en", "b", 1), (10, EN + " More.", "en", "c", 1),
    (-5, "\u00a0odd\u2003spaces\u3000here \x1f mark 's we'll \U0001f600 e\u0301", "fr", "c", 1), (2**62, FR, "fr", "\u00e9", 2),
]


def docs(spark: SparkSession, rows=DOC_ROWS) -> DataFrame:
    return spark.createDataFrame(rows, DOCS)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def sf_documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with extra columns of the given names, and a map and an array."""
    cols = ", ".join(f"'x' AS `{n}`" for n in names)
    return df.selectExpr("*", *([c for c in cols.split(", ")] if cols else []), "map('k', 1) AS extra_map", "array(1, 2) AS extra_list")
