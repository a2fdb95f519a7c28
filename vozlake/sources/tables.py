"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: session setting of a caller whose tables are a few unsplittable files; unset, tables are read as they are
SCAN_PARTITIONS = "vozlake.scan.partitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by key into as many partitions as :data:`SCAN_PARTITIONS` asks for; without it nothing is shuffled."""
    asked = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(asked), key) if asked else df


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Parquet rows; ``key`` allows :func:`spread`."""
    df = spark.read.parquet(path)
    return spread(df, key) if key else df
