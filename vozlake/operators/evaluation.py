"""Scorer evaluation. Most reports derive from one nine-counter aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.operators import quantiles as qt
from vozlake.operators import joins, metrics, ranking

K = range(len(C.CLASSES))


def details(scored: DataFrame, truth: DataFrame, key: str = "doc_id", threshold: float = C.GLOBAL_THRESHOLD) -> DataFrame:
    """Scores joined one to one with references after inference, with case flags; a repeated key fails the job."""
    joined = joins.one_to_one(scored, truth.select(key, "expected"), key)
    correct = F.col("sentiment") == F.col("expected")
    return joined.select(
        "*", correct.alias("is_correct"), (F.col("confidence") < threshold).alias("below_80_percent"),
        (~correct & (F.col("confidence") >= threshold)).alias("high_confidence_error"))


def confusion_counts(df: DataFrame, group_cols: Sequence[str] = (), expected: str = "expected",
                     predicted: str = "sentiment", extra: Sequence[Column] = (), weight: Column | None = None) -> DataFrame:
    """Nine counters n{expected}{predicted} per group; empty cells are zero."""
    unit = weight if weight is not None else F.lit(1).cast("long")
    cells = [
        F.coalesce(F.sum(F.when((F.col(expected) == C.CLASSES[e]) & (F.col(predicted) == C.CLASSES[p]), unit)), F.lit(0)).alias(f"n{e}{p}")
        for e in K for p in K
    ]
    return df.groupBy(*group_cols).agg(*cells, *extra)


def _support(k: int) -> Column:
    return sum((F.col(f"n{k}{p}") for p in K[1:]), F.col(f"n{k}0"))


def _chosen(k: int) -> Column:
    return sum((F.col(f"n{e}{k}") for e in K[1:]), F.col(f"n0{k}"))


def _share(part: Column, whole: Column, empty: Column | None = None) -> Column:
    value = part / F.nullif(whole, F.lit(0))
    return value if empty is None else F.coalesce(value, empty)


def _f1(k: int) -> Column:
    return _share(2.0 * F.col(f"n{k}{k}"), _support(k) + _chosen(k), F.lit(0.0))


def total() -> Column:
    return sum((_support(k) for k in K[1:]), _support(0))


def confusion_matrix(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return counts.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(C.CLASSES[e]).alias("expected"), F.lit(C.CLASSES[p]).alias("predicted"), F.col(f"n{e}{p}").alias("n"))
        for e in K for p in K])))


def class_metrics(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support and accuracy per class; 0 where undefined."""
    def row(k: int) -> Column:
        hit = F.col(f"n{k}{k}")
        return F.struct(
            F.lit(C.CLASSES[k]).alias("class"), F.round(_share(hit, _chosen(k), F.lit(0.0)), 6).alias("precision"),
            F.round(_share(hit, _support(k), F.lit(0.0)), 6).alias("recall"), F.round(_f1(k), 6).alias("f1"),
            _support(k).alias("support"), F.round(_share(hit, _support(k)), 6).alias("accuracy"))

    return counts.select(*group_cols, F.inline(F.array(*[row(k) for k in K])))


def summary(counts: DataFrame, keep: Sequence[str | Column] = ()) -> DataFrame:
    """Accuracy, macro and support-weighted F1 per group."""
    n = total()
    hits = sum((F.col(f"n{k}{k}") for k in K[1:]), F.col("n00"))
    macro = sum((_f1(k) for k in K[1:]), _f1(0)) / float(len(C.CLASSES))
    weighted = sum((_f1(k) * _support(k) for k in K[1:]), _f1(0) * _support(0)) / F.nullif(n, F.lit(0))
    return counts.select(
        *keep, n.alias("cases"), F.round(_share(hits, n), 6).alias("accuracy"),
        F.round(macro, 6).alias("macro_f1"), F.round(weighted, 6).alias("weighted_f1"))


def label_distribution(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return counts.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(C.CLASSES[k]).alias("class"), _support(k).alias("expected_count"), _chosen(k).alias("predicted_count"))
        for k in K])))


def error_flows(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    matrix = confusion_matrix(counts, group_cols)
    return matrix.filter("expected <> predicted and n > 0").orderBy(F.col("n").desc(), "expected", "predicted")


def confidence_diagnostics(cases: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return cases.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("cases"), metrics.mean_confidence().alias("mean_confidence"),
        F.count_if("below_80_percent").alias("below_80_count"),
        F.round(F.count_if("below_80_percent") * 100.0 / F.count(F.lit(1)), 6).alias("below_80_percentage"),
        F.count_if("high_confidence_error").alias("high_confidence_errors"))


def margin_distribution(cases: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    found = qt.exact_quantiles(cases, group_cols, F.col("prediction_margin"), {"p25": 25, "median": 50, "p75": 75})
    return found.select(
        *group_cols, F.round("minimum", 6).alias("margin_min"), F.round("p25", 8).alias("p25"), F.round("median", 8).alias("median"),
        F.round("p75", 8).alias("p75"), F.round("maximum", 6).alias("margin_max"), F.round(F.col("total") / F.col("n"), 6).alias("margin_mean"))


def confidence_by_outcome(cases: DataFrame) -> DataFrame:
    found = qt.exact_quantiles(cases, ["is_correct"], F.col("confidence"), {"median": 50})
    return found.select("is_correct", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean_confidence"), F.round("median", 8).alias("median_confidence"))


def subset_accuracy(cases: DataFrame, subsets: Mapping[str, Column], predicted: str = "sentiment") -> DataFrame:
    """Overlapping subsets in one pass; accuracy is null for an empty subset."""
    aggregates = []
    for k, (_, test) in enumerate(subsets.items()):
        aggregates += [
            F.count_if(test).alias(f"n_{k}"), F.count_if(test & F.col("is_correct")).alias(f"c_{k}"),
            *[F.count_if(test & (F.col(predicted) == c)).alias(f"p_{k}_{s}") for c, s in C.CLASS_SLUGS.items()],
        ]
    counted = cases.agg(*aggregates)
    return counted.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("subset"), F.col(f"n_{k}").alias("cases"), F.col(f"c_{k}").alias("correct"),
            (F.col(f"n_{k}") - F.col(f"c_{k}")).alias("errors"),
            F.round(F.col(f"c_{k}") / F.nullif(F.col(f"n_{k}"), F.lit(0)), 6).alias("accuracy"),
            *[F.col(f"p_{k}_{s}").alias(f"predicted_{s}") for s in C.CLASS_SLUGS.values()])
        for k, name in enumerate(subsets)])))


def accuracy_by_dimensions(cases: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """Accuracy along several dimensions from one scan."""
    long = cases.select("is_correct", F.inline(F.array(*[
        F.struct(F.lit(name).alias("dimension"), col.cast("string").alias("value")) for name, col in dimensions.items()])))
    return long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("is_correct").alias("correct"),
        F.round(F.count_if("is_correct") / F.count(F.lit(1)), 6).alias("accuracy"))


def router_sweep(cases: DataFrame, margins: Sequence[float] = C.MARGIN_SWEEP, threshold: float = C.GLOBAL_THRESHOLD) -> DataFrame:
    """Review strategies compared from one small aggregate.

    A strategy only sees whether confidence is low and which margin step a case
    falls into, so cases collapse to a few dozen rows before strategies apply.
    """
    step = sum((F.when(F.col("prediction_margin") < m, 0).otherwise(1) for m in margins[1:]),
               F.when(F.col("prediction_margin") < margins[0], 0).otherwise(1))
    cells = cases.groupBy((F.col("confidence") < threshold).alias("low"), step.alias("step"), "is_correct").agg(F.count(F.lit(1)).alias("n"))
    strategies = [(f"confidence_lt_{threshold:.2f}", -1)] + [
        (f"confidence_lt_{threshold:.2f}_or_margin_lt_{m:.2f}", k) for k, m in enumerate(margins)]
    offered = cells.select("*", F.inline(F.array(*[
        F.struct(F.lit(k).alias("position"), F.lit(name).alias("strategy"), F.lit(k - 1).alias("reach")) for k, (name, _) in enumerate(strategies)])))
    sent = F.col("low") | (F.col("step") <= F.col("reach"))
    n = F.col("n")
    zero = F.lit(0)
    found = offered.groupBy("position", "strategy").agg(
        F.sum(n).alias("_cases"), F.coalesce(F.sum(F.when(~F.col("is_correct"), n)), zero).alias("_errors"),
        F.coalesce(F.sum(F.when(sent, n)), zero).alias("review_count"),
        F.coalesce(F.sum(F.when(sent & ~F.col("is_correct"), n)), zero).alias("local_errors_captured"),
        F.coalesce(F.sum(F.when(sent & F.col("is_correct"), n)), zero).alias("local_correct_sent_to_review"))
    return found.select(
        "strategy", "review_count", F.round(F.col("review_count") * 100.0 / F.col("_cases"), 6).alias("review_coverage_percentage"),
        "local_errors_captured", (F.col("_errors") - F.col("local_errors_captured")).alias("local_errors_missed"),
        "local_correct_sent_to_review",
        F.round(_share(F.col("local_errors_captured"), F.col("review_count"), F.lit(0.0)), 6).alias("router_error_precision"))


def abstention_sweep(cases: DataFrame, thresholds: Sequence[float] = C.ABSTENTION_SWEEP) -> DataFrame:
    """Coverage, selective quality and abstention per class at each threshold."""
    level = sum((F.when(F.col("confidence") >= t, 1).otherwise(0) for t in thresholds[1:]),
                F.when(F.col("confidence") >= thresholds[0], 1).otherwise(0))
    cells = cases.groupBy("expected", "sentiment", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    swept = cells.select("*", F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.lit(k + 1).alias("need")) for k, t in enumerate(thresholds)])))
    covered = F.col("level") >= F.col("need")
    zero = F.lit(0)
    per_class = []
    for c, s in C.CLASS_SLUGS.items():
        own = F.col("expected") == c
        per_class += [F.coalesce(F.sum(F.when(own, F.col("n"))), zero).alias(f"_all_{s}"),
                      F.coalesce(F.sum(F.when(own & ~covered, F.col("n"))), zero).alias(f"_out_{s}")]
    counts = confusion_counts(swept, ["threshold"], weight=F.when(covered, F.col("n")), extra=[F.sum("n").alias("_cases"), *per_class])
    hits = sum((F.col(f"n{k}{k}") for k in K[1:]), F.col("n00"))
    quality = summary(counts, ["threshold", "_cases", hits.alias("_hits"), *[f"_{a}_{s}" for s in C.CLASS_SLUGS.values() for a in ("all", "out")]])
    return quality.select(
        "threshold", F.col("cases").alias("covered_cases"), F.round(F.col("cases") / F.col("_cases"), 6).alias("coverage"),
        F.col("accuracy").alias("selective_accuracy"), F.when(F.col("cases") > 0, F.col("macro_f1")).alias("selective_macro_f1"),
        *[F.round(_share(F.col(f"_out_{s}"), F.col(f"_all_{s}")), 6).alias(f"abstention_{s}") for s in C.CLASS_SLUGS.values()],
        (F.col("cases") - F.col("_hits")).alias("errors_remaining"))


def representative_errors(cases: DataFrame, key: str = "doc_id") -> DataFrame:
    """The most confident error of each flow."""
    errors = cases.filter(~F.col("is_correct"))
    picked = ranking.first_per_group(errors, ["expected", "sentiment"], [F.col("confidence").desc(), F.col(key).asc()], 1)
    return picked.select(key, "expected", "sentiment", "confidence").orderBy(F.col("confidence").desc(), key)
