"""Cutting lineage so that a lost executor never changes an answer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="vozlake-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows to a new table in the shared folder and read it back.

    Stored rows do not change when a task is repeated, so partition numbers and
    sampled range bounds stay as they were. Unlike a row checkpoint the table keeps
    its column layout and its size, which later scans and join choices use.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, for files a job writes and reads back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
