"""Cutting a plan in two."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share (a temporary one only in local mode)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder.

    For plans that must not be evaluated twice with different outcomes, such as
    ids that depend on sampled range bounds.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 17) -> DataFrame:
    """The rows by hash of the keys, in parts of about ``rows`` that adaptive execution doesn't join together: what a task sorts or groups doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)
