"""Ordered computations that must not pass through one task per group.

A plain window over a group sends the whole group to one task. Here rows are
range-partitioned by (group, order), each partition is scanned on its own and
what earlier partitions contribute is added from a table with one row per
(group, partition).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vozlake.durable import cut


def join_groups(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on group columns in which a null group meets the null group.

    A plain equality would drop null groups, and the "is not null" filter it adds
    to one side would keep two readers from sharing one shuffle.
    """
    keyed = right.withColumnsRenamed({c: f"_k_{c}" for c in cols})
    condition = F.lit(True)
    for c in cols:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return left.join(keyed, condition, how).drop(*[f"_k_{c}" for c in cols])


def place(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
          partitions: int | None = None) -> DataFrame:
    """Range-partition and store, adding the partition number as ``_part``."""
    keys = [F.col(c) for c in group_cols] + list(order)
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return cut(spread.withColumn("_part", F.spark_partition_id()))


def scan(placed: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
         sums: Mapping[str, Column] | None = None,
         maxima: Mapping[str, Column] | None = None, keep_part: bool = False) -> DataFrame:
    """Running sums and maxima in order; ``placed`` comes from :func:`place`.

    ``keep_part`` leaves ``_part`` in place for a further scan in the same order.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    local = Window.partitionBy(*group_cols, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_part = placed.groupBy(*group_cols, "_part").agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_m_{n}") for n, c in maxima.items()],
    )
    carried = per_part.select(
        *group_cols, "_part",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.max(f"_m_{n}").over(earlier).alias(f"_m_{n}") for n in maxima],
    )
    running = placed.select(
        "*",
        *[F.sum(c).over(local).alias(f"_ls_{n}") for n, c in sums.items()],
        *[F.max(c).over(local).alias(f"_lm_{n}") for n, c in maxima.items()],
    )
    running = join_groups(running, carried, [*group_cols, "_part"])
    kept = [c for c in placed.columns if keep_part or c != "_part"]
    return running.select(
        *kept,
        *[(F.col(f"_ls_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums],
        *[F.greatest(F.col(f"_lm_{n}"), F.col(f"_m_{n}")).alias(n) for n in maxima],
    )


def numbered(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
             name: str = "position", partitions: int | None = None) -> DataFrame:
    """1-based position inside each group, for groups of any size."""
    placed = place(df, group_cols, order, partitions)
    return scan(placed, group_cols, order, sums={name: F.lit(1).cast("long")})


def first_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                    count: int, name: str = "rank") -> DataFrame:
    """Top ``count`` rows per group; Spark trims each input partition first."""
    window = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= count)
