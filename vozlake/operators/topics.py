"""Negative-feedback topics and their Pareto block."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from vozlake import constants as C
from vozlake.functions import text as tx
from vozlake.operators import ranking


def terms(df: DataFrame, keep: Sequence[str], text_col: str = "text",
          stop_words: Iterable[str] | None = C.TOPIC_STOP_WORDS) -> DataFrame:
    """One row per (comment, distinct unigram or bigram).

    The outer form plus a later null test keeps the optimizer from adding a
    second tokenisation as a "not empty" pre-filter.
    """
    exploded = df.select(*keep, F.explode_outer(tx.topic_terms_of(text_col, tuple(stop_words) if stop_words else None)).alias("topic"))
    return exploded.filter(F.col("topic").isNotNull())


def document_frequency(df: DataFrame, group_cols: Sequence[str] = (), text_col: str = "text",
                       min_df: int = 1, stop_words: Iterable[str] | None = C.TOPIC_STOP_WORDS) -> DataFrame:
    """Comments per term: (group..., topic, frequency, n_words)."""
    counted = terms(df, list(group_cols), text_col, stop_words).groupBy(*group_cols, "topic").agg(
        F.count(F.lit(1)).alias("frequency"),
        # an aggregate, so a later test on it cannot be pushed below the counting
        # and the counted shuffle is shared by every reader
        F.max(F.when(F.col("topic").contains(" "), 2).otherwise(1)).alias("n_words"),
    )
    return counted.filter(F.col("frequency") >= min_df) if min_df > 1 else counted


def _topic_order() -> list:
    return [F.col("frequency").desc(), F.col("n_words").desc(), F.col("topic").asc()]


def select_topics(counts: DataFrame, group_cols: Sequence[str] = (),
                  max_topics: int = C.MAX_TOPICS) -> DataFrame:
    """Best topics per group without unigrams covered by an equally frequent bigram.

    A unigram is passed over exactly when some bigram holding it has the same
    frequency. Bigrams are never passed over and come before unigrams of their
    frequency, so with k = ``max_topics`` only unigrams more frequent than the k-th
    bigram can be selected. Bigrams that cover those are among the first k and hold two
    words each, so at most 2k unigrams are passed over before the k-th selected one:
    the first k bigrams and 3k unigrams of a group decide it. Spark keeps those of each
    partition before it moves them; no other count leaves its partition.
    """
    groups = list(group_cols)
    leading = ranking.first_per_group(counts, [*groups, "n_words"], [F.col("frequency").desc(), F.col("topic").asc()], 3 * max_topics, "_place")
    contenders = leading.filter((F.col("n_words") == 1) | (F.col("_place") <= max_topics)).drop("_place")
    words = F.when(F.col("n_words") == 2, F.concat(F.array("topic"), F.split("topic", " "))).otherwise(F.array("topic"))
    uncovered = (
        contenders.select(*groups, "topic", "frequency", "n_words", F.explode(words).alias("word"))
        .groupBy(*groups, "word")
        .agg(
            F.max(F.when(F.col("word") == F.col("topic"), F.col("frequency"))).alias("frequency"),
            # a bigram covers only at its own frequency, which is the unigram's at most
            F.max(F.when(F.col("word") != F.col("topic"), F.col("frequency"))).alias("_cover"),
        )
        .filter(F.col("frequency").isNotNull() & ~F.col("frequency").eqNullSafe(F.col("_cover")))
        .select(
            *groups, F.col("word").alias("topic"), "frequency",
            F.when(F.col("word").contains(" "), 2).otherwise(1).alias("n_words"),
        )
    )
    if not groups:
        uncovered = uncovered.orderBy(*_topic_order()).limit(max_topics)
    return ranking.first_per_group(uncovered, groups, _topic_order(), max_topics)


def pareto(topics: DataFrame, group_cols: Sequence[str] = (), threshold: float = C.PARETO_THRESHOLD,
           bounded: bool = False) -> DataFrame:
    """Shares, running shares and the block that first reaches ``threshold``.

    ``bounded=True`` states that a group holds at most a few topics (it comes
    from :func:`select_topics`), which allows a plain window. Any other topic
    table is scanned over range partitions.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    groups = list(group_cols)
    rows = topics.select(*groups, "topic", F.col("frequency").cast("long").alias("frequency")).filter("frequency > 0")
    order = [F.col("frequency").desc(), F.col("topic").asc()]
    if bounded:
        running = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = rows.select(
            "*",
            F.sum("frequency").over(running).alias("_upto"),
            F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).alias("rank"),
            F.sum("frequency").over(Window.partitionBy(*groups)).alias("_total"),
        )
    else:
        placed = ranking.place(rows, groups, order)
        scanned = ranking.scan(placed, groups, order,
                               sums={"_upto": F.col("frequency"), "rank": F.lit(1).cast("long")})
        totals = placed.groupBy(*groups).agg(F.sum("frequency").alias("_total"))
        ranked = ranking.join_groups(scanned, totals, groups) if groups else scanned.withColumn("_total", totals.scalar())
    upto, total = F.col("_upto"), F.col("_total")
    return ranked.select(
        *groups, F.col("rank").cast("int").alias("rank"), "topic", "frequency",
        F.round(F.col("frequency") * 100.0 / total, 6).alias("percentage"),
        F.round(upto * 100.0 / total, 6).alias("cumulative_percentage"),
        # what came before this row against the threshold, free of float drift
        (upto - F.col("frequency") < F.round(total * F.lit(float(threshold)), 6)).alias("within_80_percent"),
    )


def negative_topics(scored: DataFrame, group_cols: Sequence[str] = (), text_col: str = "text",
                    max_topics: int = C.MAX_TOPICS, min_df: int = 1,
                    threshold: float = C.PARETO_THRESHOLD,
                    stop_words: Iterable[str] | None = C.TOPIC_STOP_WORDS) -> DataFrame:
    """Scored comments to the Pareto table of their negative topics."""
    negative = scored.filter(F.col("sentiment") == C.NEGATIVE)
    counts = document_frequency(negative, group_cols, text_col, min_df, stop_words)
    return pareto(select_topics(counts, group_cols, max_topics), group_cols, threshold, bounded=True)
