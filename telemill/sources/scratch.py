"""A folder that all executors share, for tables that outlive one job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset the warehouse, or on one machine a temporary folder."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if where.startswith("file:") or "://" not in where:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; a warehouse on the driver's disk isn't one")
        return where
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="telemill-")
    return _local[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/telemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as a table in the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
