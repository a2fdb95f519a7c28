"""Batch metrics of scored comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.operators import quantiles, ranking


def sentiment_metrics(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """One wide row per batch: counts, shares, ratio, confidence, critical rows.

    Everything is derived from one stored histogram over (batch, class, confidence), so
    the comments themselves are read and scored once.
    """
    groups = list(group_cols)
    keys = groups or ["_all"]
    single = scored if groups else scored.withColumn("_all", F.lit(0))
    hist = cut(single.groupBy(*keys, "sentiment", "confidence").agg(F.count(F.lit(1)).alias("_n")), "confidences")
    n = F.col("_n")
    limits = quantiles.exact_quantiles(hist, keys, F.col("confidence"), {"_p75": 75}, weight=n, stored=True)
    limits = limits.select(*keys, "_p75", (F.col("total") / F.col("n")).alias("_mean"))
    strong = (F.col("sentiment") == C.NEGATIVE) & (F.col("confidence") >= F.col("_p75"))
    totals = ranking.join_groups(hist, limits, keys, "left").groupBy(*keys).agg(
        F.sum("_n").alias("total"), F.max("_p75").alias("_p75"), F.max("_mean").alias("_mean"),
        F.coalesce(F.sum(F.when(strong, n)), F.lit(0)).alias("_critical"),
        *[F.coalesce(F.sum(F.when(F.col("sentiment") == c, n)), F.lit(0)).alias(f"{s}_count") for c, s in C.CLASS_SLUGS.items()],
    )
    positive, negative = F.col("positive_count"), F.col("negative_count")
    ratio = (
        F.when(negative > 0, positive / F.when(negative > 0, negative))
        .when(positive > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    )
    return totals.select(
        *groups, "total", "negative_count", "neutral_count", "positive_count",
        *[F.round(F.col(f"{s}_count") * 100.0 / F.col("total"), 6).alias(f"{s}_percentage") for s in C.CLASS_SLUGS.values()],
        F.round(ratio, 6).alias("positive_negative_ratio"),
        F.round("_mean", 6).alias("mean_confidence"),
        F.round("_p75", 8).alias("critical_confidence_threshold"),
        F.col("_critical").alias("critical_negative_count"),
    )


def sentiment_distribution(metrics: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Three rows per batch in class order, zero counts kept."""
    return metrics.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(k).alias("position"), F.lit(c).alias("sentiment"), F.col(f"{s}_count").alias("count"),
                 F.col(f"{s}_percentage").alias("percentage"))
        for k, (c, s) in enumerate(C.CLASS_SLUGS.items())])))


def confidence_by_class(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*group_cols, "sentiment").agg(mean_confidence().alias("mean_confidence"))


def mean_confidence() -> Column:
    return F.round(F.avg("confidence"), 6)


def state_shares(results: DataFrame, state: str | Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """Share of each trace state inside its batch."""
    column = F.col(state) if isinstance(state, str) else state
    counts = results.groupBy(*group_cols, column.alias("state")).agg(F.count(F.lit(1)).alias("count"))
    # one row per state, so the window holds a handful of rows per batch
    total = F.sum("count").over(Window.partitionBy(*group_cols))
    return counts.withColumn("percentage", F.round(F.col("count") * 100.0 / total, 6))
