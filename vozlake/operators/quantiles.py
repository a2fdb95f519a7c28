"""Exact quantiles of values of any precision, by selection.

Equal values are counted first. A group of few distinct values is read off by one window. A
larger one is split at pivots that a quantile sketch gives; exact counts between the pivots
say which piece holds a wanted position, and only that piece is looked at again. Sketches and
counts are combinable, so nothing is sorted or range-partitioned as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vozlake.durable import cut
from vozlake.operators import ranking

#: distinct values of a group that one window may take
HELD = 65_536
#: pieces that a larger group is split into
PIECES = 256


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value: Column, percents: Mapping[str, int],
                    lower: Mapping[str, int] | None = None, weight: Column | None = None,
                    stored: bool = False, held: int = HELD, pieces: int = PIECES) -> DataFrame:
    """One row per group: quantiles plus count, sum, min and max; no task holds more than ``held`` values of a group.

    ``percents`` are interpolated, ``lower`` take the value at floor(percent / 100 * (n - 1)). A row counts ``weight`` times.
    Nulls are left out; a group of nulls only has no row. ``stored`` states that ``df`` is a stored table, cheap to count again.
    """
    if held < 1 or pieces < 2:
        raise ValueError("held must be at least 1 and pieces at least 2")
    groups, lower = list(group_cols), dict(lower or {})
    keys = groups or ["_all"]
    unit = F.lit(1).cast("long") if weight is None else weight
    rows = df if groups else df.withColumn("_all", F.lit(0))
    hist = rows.select(*keys, value.alias("_v"), unit.alias("_w")).filter(F.col("_v").isNotNull()) \
        .groupBy(*keys, "_v").agg(F.sum("_w").alias("_n")).filter("_n > 0")
    hist = hist if stored else cut(hist, "values")
    asked = sorted({(p, step) for p in percents.values() for step in (0, 1)} | {(p, 0) for p in lower.values()})
    summary = [F.sum("_n").alias("n"), F.sum(F.col("_v") * F.col("_n")).alias("total"),
               F.min("_v").alias("minimum"), F.max("_v").alias("maximum")]

    def position(percent: int, step: int, size: Column) -> Column:
        return F.least(F.floor(F.lit(percent) * (size - 1) / 100) + step, size - 1).cast("long")

    largest = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values")).agg(F.max("_values")).first()[0] or 0
    if largest <= held:
        everything = Window.partitionBy(*keys)
        upto = F.sum("_n").over(everything.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        run = hist.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(everything))
        answered = run.groupBy(*keys).agg(*summary, *[
            F.min(F.when(F.col("_upto") > position(*a, F.col("_all")), F.col("_v"))).alias(f"_a{k}") for k, a in enumerate(asked)])
    else:
        sizes = cut(hist.groupBy(*keys).agg(*summary, F.count(F.lit(1)).alias("_values")), "sizes")
        wanted = sizes.select(*keys, "_values", F.inline(F.array(*[
            F.struct(F.lit(k).alias("_ask"), position(*a, F.col("n")).alias("_at")) for k, a in enumerate(asked)])))
        found = _select(hist, keys, wanted, largest, held, pieces)
        answers = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_ask") == k, F.col("_v"))).alias(f"_a{k}") for k in range(len(asked))])
        answered = ranking.join_groups(sizes, answers, keys)

    def at(percent: int, step: int) -> Column:
        return F.col(f"_a{asked.index((percent, step))}")

    def interpolated(percent: int) -> Column:
        share = (F.lit(percent) * (F.col("n") - 1) % 100) / 100
        return at(percent, 0) + (at(percent, 1) - at(percent, 0)) * share

    return answered.select(
        *groups, "n", "total", "minimum", "maximum",
        *[interpolated(p).alias(k) for k, p in percents.items()], *[at(p, 0).alias(k) for k, p in lower.items()])


def _within(hist: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values with the span (``_low``, ``_high``] they lie in; a null bound is open. Spans of a group don't overlap."""
    named = spans.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    meet = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    inside = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    return hist.join(named, meet & inside).drop(*[f"_k_{c}" for c in keys])


def _select(hist: DataFrame, keys: list[str], wanted: DataFrame, largest: int, held: int, pieces: int) -> DataFrame:
    """(keys, _ask, _v): the value at each wanted position.

    A wanted position has a row with its span, the weight ``_base`` below the span and the number of distinct ``_values`` in it.
    """
    kind = hist.schema["_v"].dataType
    spans = wanted.withColumns({"_low": F.lit(None).cast(kind), "_high": F.lit(None).cast(kind), "_base": F.lit(0).cast("long")})
    small, of_span = [], [*keys, "_low", "_high"]
    while largest > held:
        small.append(spans.filter(F.col("_values") <= held))
        wide = spans.filter(F.col("_values") > held)
        # the least pivot is below the greatest value, so every split makes its span smaller
        shares = F.array(*[F.lit(k / pieces) for k in range(1, pieces)])
        pivots = _within(hist, wide.select(*of_span).distinct(), keys).groupBy(*of_span).agg(
            F.percentile_approx("_v", shares, 20 * pieces).alias("_pivots"))
        piece = F.size(F.filter("_pivots", lambda p: p < F.col("_v")))
        split = _within(hist, cut(pivots, "pivots"), keys).withColumn("_piece", piece).groupBy(
            *of_span, "_piece",
            F.coalesce(F.get("_pivots", F.col("_piece") - 1), "_low").alias("_new_low"),
            F.coalesce(F.get("_pivots", "_piece"), "_high").alias("_new_high"),
        ).agg(F.sum("_n").alias("_weight"), F.count(F.lit(1)).alias("_new_values"))
        # at most ``pieces`` rows per span
        before = F.sum("_weight").over(Window.partitionBy(*of_span).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
        split = split.withColumn("_before", F.coalesce(before, F.lit(0)))
        placed = ranking.join_groups(wide, split, of_span).withColumn("_offset", F.col("_at") - F.col("_base"))
        placed = placed.filter((F.col("_offset") >= F.col("_before")) & (F.col("_offset") < F.col("_before") + F.col("_weight")))
        spans = cut(placed.select(
            *keys, F.col("_new_values").alias("_values"), "_ask", "_at", F.col("_new_low").alias("_low"), F.col("_new_high").alias("_high"),
            (F.col("_base") + F.col("_before")).alias("_base")), "spans")
        largest = spans.agg(F.max("_values")).first()[0] or 0
    spans = reduce(DataFrame.unionByName, small, spans)
    upto = F.sum("_n").over(Window.partitionBy(*of_span).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = _within(hist, spans.select(*of_span).distinct(), keys).withColumn("_upto", upto)
    offset = F.col("_at") - F.col("_base")
    return ranking.join_groups(run, spans, of_span).filter(
        (F.col("_upto") > offset) & (F.col("_upto") - F.col("_n") <= offset)).select(*keys, "_ask", "_v")
