"""Append-only journals and cost logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vozlake import constants as C
from vozlake.sources import folders


def missing_fields(raw: Column, required: Sequence[str]) -> Column:
    """Required fields absent from a raw JSON record."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(r) for r in required]), keys)


def append_records(records: DataFrame, path: str, required: Sequence[str], raw: str = "raw", run: str | None = None) -> DataFrame:
    """Append complete records as JSON lines; returns the rejected ones with their gaps.

    With ``run`` the lines go to a folder of that run: a repeated run that was complete adds nothing, an interrupted one is
    written anew, and :func:`read_runs` never sees half a run. Without it, repeating the call repeats the lines.
    """
    judged = records.withColumn("missing", missing_fields(F.col(raw), required))
    lines = judged.filter(F.size("missing") == 0).select(F.col(raw).alias("value"))
    if run is None:
        lines.write.mode("append").text(path)
    elif not folders.is_complete(records.sparkSession, folders.child(path, "run", run)):
        folders.writer(lines).text(folders.child(path, "run", run))
    return judged.filter(F.size("missing") > 0)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _runs(spark: SparkSession, path: str) -> list[str]:
    return [folders.child(path, "run", name) for name in folders.complete(spark, path, "run")]


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all complete runs; no run, no rows."""
    found = _runs(spark, path)
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)


def append_costs(rows: DataFrame, path: str, fields: Sequence[str] = C.COST_FIELDS, run: str | None = None) -> None:
    """Append cost rows; every contract field must be a column, order is fixed. ``run`` as in :func:`append_records`."""
    absent = [f for f in fields if f not in rows.columns]
    if absent:
        raise ValueError(f"cost rows lack fields: {absent}")
    kept = rows.select(*fields)
    if run is None:
        kept.write.mode("append").parquet(path)
    elif not folders.is_complete(rows.sparkSession, folders.child(path, "run", run)):
        folders.writer(kept).parquet(folders.child(path, "run", run))


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """Cost rows of all complete runs."""
    found = _runs(spark, path)
    if not found:
        raise ValueError(f"no complete run below {path}")
    return spark.read.parquet(*found)


def write_metrics(rows: DataFrame, path: str) -> None:
    """Long metrics table as JSON lines."""
    rows.write.json(path)
