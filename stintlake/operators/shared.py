"""Iterations cut their lineage with tables in the folder that driver and executors share; rows that grow are spread first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, on one machine (tests), a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or tempfile.mkdtemp(prefix="stintlake-")


def durable(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back: neither plans nor their broadcasts grow with the
    passes, and no pass is computed a second time, as ``checkpoint`` does."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Dealt by columns over as many partitions as the session has for shuffles: small rows of which each makes many
    are neither read in one task nor put together again by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
