"""reco: recommendation analytics as Spark DataFrame / SQL / pyspark.ml jobs."""

__version__ = "0.1.0"
