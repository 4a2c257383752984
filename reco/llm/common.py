"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from reco.deploy import ship_package
from reco.session import app_scratch_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return f"{app_scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: a
    lineage cut that survives lost executors, with real sizes for Catalyst.
    ``by``: columns whose values become folders, so that readers skip them."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_executors(spark: SparkSession) -> None:
    """Make this package importable in every Python worker."""
    ship_package(spark)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a task that writes or reads whole files.
    ``file:`` paths are local mounts; other URIs go through pyarrow."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def arrow_batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def free_name(taken: list[str], name: str) -> str:
    """``name``, prefixed with underscores until no input column clashes."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
