"""Query registry and access to the input tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vozlake import constants as C
from vozlake.plans import inputs
from vozlake.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# tables whose rows are costly to process, with the key that places them
SPREAD_KEYS = {"documents": "doc_id", "events": "event_id"}


class Tables:
    """Base tables by attribute, derived inputs by :meth:`derived`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.path(name), SPREAD_KEYS.get(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def derived(self, name: str) -> DataFrame:
        """A derived input: plain SQL text over base tables or other derived ones."""
        sql = inputs.DERIVED[name]
        used = {}
        for source in set(re.findall(r"\{(\w+)\}", sql)):
            used[source] = self.derived(source) if source in inputs.DERIVED else getattr(self, source)
        return self.spark.sql(sql, **used)


def query(name: str, sql: str | None = None, scores: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL check.

    ``scores`` names the probabilities among its columns; the last step of query and check rounds them alike.
    """
    columns, digits = scores.split(), C.PROBABILITY_DECIMALS
    if sql is not None and columns:
        sql = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({sql.strip()})"

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder)).withColumns({c: F.round(c, digits) for c in columns})
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap
