"""Folders of one job each below a shared path: complete once their success marker is there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_MARKER = "_SUCCESS"
_NAME = re.compile(r"[A-Za-z0-9._-]+")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def child(path: str, kind: str, name: str | int) -> str:
    """Folder of job ``name``; ``kind-name`` is no partition column, so tables keep their own columns."""
    if not _NAME.fullmatch(str(name)):
        raise ValueError(f"not a folder name: {name!r}")
    return f"{path.rstrip('/')}/{kind}-{name}"


def writer(df: DataFrame) -> DataFrameWriter:
    """Replaces what an interrupted job left; the marker comes last."""
    return df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")


def is_complete(spark: SparkSession, folder: str) -> bool:
    system, place = _file_system(spark, f"{folder}/{_MARKER}")
    return system.exists(place)


def complete(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Names of the complete folders of a kind, sorted as text."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    found = [s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()]
    names = sorted(n.removeprefix(f"{kind}-") for n in found if n.startswith(f"{kind}-"))
    return [n for n in names if is_complete(spark, child(path, kind, n))]


def drop(spark: SparkSession, folder: str) -> None:
    """Remove one folder of :func:`child`."""
    system, place = _file_system(spark, folder)
    system.delete(place, True)
