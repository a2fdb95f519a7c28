"""Cost, latency and validity analytics of request logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.operators import quantiles as qt


def request_cost(input_tokens: str = "input_tokens", output_tokens: str = "output_tokens") -> Column:
    """Null only when both token counts are null."""
    spent = (F.coalesce(F.col(input_tokens), F.lit(0)) * C.INPUT_TOKEN_COST_USD
             + F.coalesce(F.col(output_tokens), F.lit(0)) * C.OUTPUT_TOKEN_COST_USD)
    return F.when(F.col(input_tokens).isNull() & F.col(output_tokens).isNull(), None).otherwise(spent)


def priced(log: DataFrame) -> DataFrame:
    return log.withColumn("cost_usd", request_cost())


def latest_records(log: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Last appended record per key, by a combinable aggregate instead of a window."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_last")).select(*keys, "_last.*")


def pending(cases: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Cases without a log record yet."""
    return cases.join(log.select(key).distinct(), key, "left_anti")


def by_architecture(log: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Calls, cost and latency per evaluated comment; ``evaluated(architecture, comments)``."""
    spent = priced(log).groupBy("architecture").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("_cost"),
        F.sum("latency_ms").alias("_latency"), F.count_if(F.col("state") != "success").alias("failures"))
    n = F.col("comments")
    return spent.join(evaluated, "architecture").select(
        "architecture", "calls", F.round(F.col("calls") / n, 6).alias("calls_per_comment"), F.round("_cost", 8).alias("cost_usd"),
        F.round(F.col("_cost") / n, 12).alias("cost_per_comment_usd"), F.round(F.col("_latency") / n, 8).alias("mean_latency_ms_per_comment"), "failures")


def by_call_type(log: DataFrame, group_cols: Sequence[str] = ("call_type",)) -> DataFrame:
    money = priced(log).groupBy(*group_cols).agg(F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 8).alias("cost_usd"))
    return money.join(latency_summary(log, group_cols), list(group_cols))


def latency_summary(log: DataFrame, group_cols: Sequence[str] = (), latency: str = "latency_ms") -> DataFrame:
    """min, median, interpolated p95, lower p95, max, mean of the values as logged.

    The lower p95 is the order statistic at floor(0.95 * (n - 1)).
    """
    found = qt.exact_quantiles(log, group_cols, F.col(latency), {"median": 50, "p95": 95}, {"p95_lower": 95})
    return found.select(
        *group_cols, "n", F.col("minimum").alias("latency_min"), F.round("median", 6).alias("latency_median"),
        F.round("p95", 6).alias("latency_p95"), F.col("p95_lower").alias("latency_p95_lower"), F.col("maximum").alias("latency_max"),
        F.round(F.col("total") / F.col("n"), 8).alias("latency_mean"))


def token_totals(log: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Token sums (null as 0), mean and max output, and cost per 1, 100 and 1000 comments."""
    zero, n = F.lit(0), F.count(F.lit(1))
    cost = F.sum(F.coalesce("cost_usd", F.lit(0.0)))
    return priced(log).groupBy(*group_cols).agg(
        n.alias("requests"), F.sum(F.coalesce("input_tokens", zero)).alias("input_tokens"), F.sum(F.coalesce("output_tokens", zero)).alias("output_tokens"),
        F.sum(F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero)).alias("total_tokens"),
        F.round(F.avg("output_tokens"), 6).alias("mean_output_tokens"), F.max("output_tokens").alias("max_output_tokens"),
        F.round(cost, 8).alias("cost_usd"), F.round(cost / n, 12).alias("cost_per_comment_usd"),
        F.round(cost / n * 100, 10).alias("cost_per_100_usd"), F.round(cost / n * 1000, 9).alias("cost_per_1000_usd"))


def response_validity(log: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    code = F.coalesce("error_code", F.lit(""))
    schema = code.isin("invalid_schema", "invalid_sentiment", "invalid_rationale")
    return log.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("success").alias("valid"), F.count_if(code == "invalid_json").alias("invalid_json"),
        F.count_if(schema).alias("schema_violations"),
        F.count_if((code == "completion_truncated") | F.coalesce(F.col("finish_reason") == "length", F.lit(False))).alias("truncations"),
        F.count_if(code == "rate_limited").alias("http_429"))


def histogram(log: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Counts of several code columns at once; nulls counted as 'none'."""
    long = log.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("histogram"), F.coalesce(F.col(c), F.lit("none")).alias("value")) for name, c in columns.items()])))
    return long.groupBy("histogram", "value").agg(F.count(F.lit(1)).alias("n"))


def correct(predicted: str = "sentiment", expected: str = "expected_sentiment") -> Column:
    return F.coalesce(F.col("success") & (F.col(predicted) == F.col(expected)), F.lit(False))


def gate_metrics(log: DataFrame, languages: Sequence[str] = C.TRANSLATABLE_LANGUAGES) -> DataFrame:
    """One row of the measures the promotion gate looks at."""
    ok = correct().cast("int")
    code = F.coalesce("error_code", F.lit(""))
    long = ~F.col("short_text")
    return log.agg(
        F.count(F.lit(1)).alias("requests"), F.avg(ok).alias("accuracy"),
        *[F.avg(F.when(long & (F.col("language") == x), ok)).alias(f"accuracy_{x}") for x in languages],
        F.avg(F.when(F.col("short_text"), ok)).alias("accuracy_short"),
        F.avg(F.when(F.col("expected_sentiment") == C.NEUTRAL, ok)).alias("accuracy_neutral"),
        F.count_if((code == "completion_truncated") | F.coalesce(F.col("finish_reason") == "length", F.lit(False))).alias("truncations"),
        F.count_if(code.isin("invalid_json", "invalid_schema", "invalid_sentiment")).alias("schema_errors"),
        F.avg(F.col("success").cast("int")).alias("success_rate"))


# FIXED VALUES: gate name, measure, comparison, bound
GATES = (
    ("accuracy", "accuracy", ">=", 0.95), ("language_en", "accuracy_en", ">=", 0.90), ("language_pt", "accuracy_pt", ">=", 0.90),
    ("language_it", "accuracy_it", ">=", 0.90), ("short_text", "accuracy_short", ">=", 0.85), ("neutral", "accuracy_neutral", ">=", 0.90),
    ("truncations", "truncations", "==", 0), ("schema_errors", "schema_errors", "==", 0), ("success", "success_rate", ">=", 0.98),
)


def quality_gate(log: DataFrame, expected_requests: int | None = None) -> DataFrame:
    """One row per gate with the measured value and the verdict."""
    gates = list(GATES) + ([("requests", "requests", "==", expected_requests)] if expected_requests else [])
    measured = gate_metrics(log)
    rows = []
    for name, column, sign, bound in gates:
        value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        passed = value >= bound if sign == ">=" else value == bound
        rows.append(F.struct(F.lit(name).alias("gate"), F.round(value, 6).alias("value"), F.lit(float(bound)).alias("bound"), passed.alias("passed")))
    return measured.select(F.inline(F.array(*rows)))


def merge_recovered(previous: DataFrame, recovered: DataFrame, key: str = "case_id") -> DataFrame:
    """Totals after failed cases were repeated: old successes plus recovered ones."""
    kept = previous.filter("success").select(key, correct().alias("ok"), F.lit("previous").alias("origin"))
    fresh = recovered.select(key, correct().alias("ok"), F.lit("recovered").alias("origin"))
    return kept.unionByName(fresh).groupBy("origin").agg(F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("correct"))


def paired(log: DataFrame, key: str = "case_id") -> DataFrame:
    """Results of both architectures side by side for the cases that have both."""
    last = latest_records(log, [key, "architecture"], "event_id")
    side = {a: last.filter(F.col("architecture") == a).select(
        key, F.col("expected_sentiment").alias(f"expected_{a.lower()}"), F.col("sentiment").alias(f"sentiment_{a.lower()}"),
        F.col("local_sentiment").alias(f"local_{a.lower()}"), F.col("success").alias(f"success_{a.lower()}")) for a in ("A", "B")}
    return side["A"].join(side["B"], key)


def architecture_summary(log: DataFrame) -> DataFrame:
    """A: local verdict where the review failed. B: valid answers and end to end."""
    last = latest_records(log, ["case_id", "architecture"], "event_id")
    final = F.when((F.col("architecture") == "B") | F.col("success"), F.col("sentiment")).otherwise(F.col("local_sentiment"))
    rows = last.withColumn("_final", final)
    hit = F.coalesce(F.col("_final") == F.col("expected_sentiment"), F.lit(False)).cast("int")
    judged = F.col("success") | (F.col("architecture") == "A")
    return rows.groupBy("architecture").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(judged).alias("evaluated"), F.round(F.avg(F.when(judged, hit)), 6).alias("accuracy_on_evaluated"),
        F.round(F.avg(hit), 6).alias("end_to_end_accuracy"), F.count_if(~F.col("success")).alias("failures"),
        *[F.round(F.avg(F.when(judged & (F.col("expected_sentiment") == c), hit)), 6).alias(f"accuracy_{s}") for c, s in C.CLASS_SLUGS.items()])
