"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder: `spark.checkpoint.dir`, or a temporary folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spotlake-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path; nothing is ever deleted or overwritten."""
    return f"{scratch_root(spark)}/spotlake/{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write `df` once and read it back: lineage ends there and its true size is known.

    Spark then plans later joins against the measured size of the files. With
    `partition_by`, filters on these columns read their folders alone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
