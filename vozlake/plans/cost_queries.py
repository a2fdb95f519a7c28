"""Queries over the request log: cost, latency, validity, pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.operators import costs, evaluation as ev, pacing, quantiles as qt
from vozlake.plans import oracle as o
from vozlake.plans.registry import Tables, query

o.define("rl", """SELECT *, CASE WHEN input_tokens IS NULL AND output_tokens IS NULL THEN NULL
    ELSE coalesce(input_tokens, 0) * 0.00000035::DOUBLE + coalesce(output_tokens, 0) * 0.00000075::DOUBLE END AS cost_usd, coalesce(success AND sentiment = expected_sentiment, false) AS ok FROM request_log""")


def log(t: Tables) -> DataFrame:
    return t.derived("request_log")


@query("request_cost", o.with_ctes("SELECT event_id, input_tokens, output_tokens, round(cost_usd, 9) AS cost_usd FROM rl"))
def request_cost(t: Tables) -> DataFrame:
    return log(t).select("event_id", "input_tokens", "output_tokens", F.round(costs.request_cost(), 9).alias("cost_usd"))


o.define("rl_last", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, architecture ORDER BY event_id DESC) AS r FROM rl) WHERE r = 1")


@query("latest_records", o.with_ctes("SELECT case_id, architecture, event_id, state, latency_ms FROM rl_last"))
def latest_records(t: Tables) -> DataFrame:
    return costs.latest_records(log(t), ["case_id", "architecture"], "event_id").select("case_id", "architecture", "event_id", "state", "latency_ms")


# a resumed run: cases of the first two thirds of the log are done
_DONE = "event_id < (SELECT max(event_id) * 2 / 3 FROM events)"


@query("resume_pending", o.with_ctes(f"SELECT DISTINCT case_id FROM request_log WHERE case_id NOT IN (SELECT case_id FROM request_log WHERE {_DONE})"))
def resume_pending(t: Tables) -> DataFrame:
    rows = log(t)
    limit = t.events.agg((F.max("event_id") * 2 / 3).alias("limit")).scalar()
    return costs.pending(rows.select("case_id").distinct(), rows.filter(F.col("event_id") < limit), "case_id")


@query("failed_cases", o.with_ctes("SELECT case_id, architecture, error_code FROM rl_last WHERE NOT success"))
def failed_cases(t: Tables) -> DataFrame:
    last = costs.latest_records(log(t), ["case_id", "architecture"], "event_id")
    return last.filter(~F.col("success")).select("case_id", "architecture", "error_code")


@query("failed_cases_audit", o.with_ctes("""SELECT count(*) AS records, count(*) FILTER (NOT success) AS failed, count(DISTINCT CASE WHEN NOT success THEN case_id || ':' || architecture END) AS failed_ids FROM rl"""))
def failed_cases_audit(t: Tables) -> DataFrame:
    """Records and failures of the whole log, and the cases that failed, each counted once."""
    per_case = log(t).groupBy("case_id", "architecture").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failures"))
    return per_case.agg(F.sum("n").alias("records"), F.sum("failures").alias("failed"), F.count_if(F.col("failures") > 0).alias("failed_ids"))


@query("cost_by_architecture", o.with_ctes("""SELECT a.architecture, calls, round(calls::DOUBLE / n, 6) AS calls_per_comment, round(cost, 8) AS cost_usd, round(cost / n, 12) AS cost_per_comment_usd,
    round(lat / n, 8) AS mean_latency_ms_per_comment, failures FROM (SELECT architecture, count(*) AS calls, sum(coalesce(cost_usd, 0)) AS cost, sum(latency_ms) AS lat, count(*) FILTER (state <> 'success') AS failures FROM rl GROUP BY 1) a
    JOIN (SELECT architecture, count(DISTINCT case_id) AS n FROM rl GROUP BY 1) b USING (architecture)"""))
def cost_by_architecture(t: Tables) -> DataFrame:
    evaluated = log(t).select("architecture", "case_id").distinct().groupBy("architecture").agg(F.count(F.lit(1)).alias("comments"))
    return costs.by_architecture(log(t), evaluated)


_LOWER = "(list_sort(list({v})))[(95 * (count({v}) - 1) // 100 + 1)::BIGINT]"
_LATENCY = f"""count(*) AS n, min(latency_ms) AS latency_min, round(quantile_cont(latency_ms, 0.5), 6) AS latency_median, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95,
    {_LOWER.format(v='latency_ms')} AS latency_p95_lower, max(latency_ms) AS latency_max, round(avg(latency_ms), 8) AS latency_mean"""


@query("cost_latency_by_call_type", o.with_ctes(f"SELECT call_type, round(sum(coalesce(cost_usd, 0)), 8) AS cost_usd, {_LATENCY} FROM rl GROUP BY 1"))
def cost_latency_by_call_type(t: Tables) -> DataFrame:
    return costs.by_call_type(log(t))


@query("latency_summary", o.with_ctes(f"SELECT language, {_LATENCY} FROM rl GROUP BY 1"))
def latency_summary(t: Tables) -> DataFrame:
    return costs.latency_summary(log(t), ["language"])


@query("latency_summary_overall", o.with_ctes(f"SELECT {_LATENCY} FROM rl"))
def latency_summary_overall(t: Tables) -> DataFrame:
    return costs.latency_summary(log(t))


@query("token_cost_totals", o.with_ctes("""SELECT language, count(*) AS requests, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens,
    sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS total_tokens, round(avg(output_tokens), 6) AS mean_output_tokens, max(output_tokens) AS max_output_tokens,
    round(sum(coalesce(cost_usd, 0)), 8) AS cost_usd, round(sum(coalesce(cost_usd, 0)) / count(*), 12) AS cost_per_comment_usd, round(sum(coalesce(cost_usd, 0)) / count(*) * 100, 10) AS cost_per_100_usd,
    round(sum(coalesce(cost_usd, 0)) / count(*) * 1000, 9) AS cost_per_1000_usd FROM rl GROUP BY 1"""))
def token_cost_totals(t: Tables) -> DataFrame:
    return costs.token_totals(log(t), ["language"])


@query("response_validity", o.with_ctes("""SELECT call_type, count(*) AS requests, count(*) FILTER (success) AS valid, count(*) FILTER (error_code = 'invalid_json') AS invalid_json,
    count(*) FILTER (error_code = 'invalid_schema') AS schema_violations, count(*) FILTER (error_code = 'completion_truncated' OR finish_reason = 'length') AS truncations,
    count(*) FILTER (error_code = 'rate_limited') AS http_429 FROM rl GROUP BY 1"""))
def response_validity(t: Tables) -> DataFrame:
    return costs.response_validity(log(t), ["call_type"])


@query("response_histograms", o.with_ctes("""SELECT 'finish_reason' AS histogram, coalesce(finish_reason, 'none') AS value, count(*) AS n FROM rl GROUP BY 2
    UNION ALL SELECT 'error_code', coalesce(error_code, 'none'), count(*) FROM rl GROUP BY 2"""))
def response_histograms(t: Tables) -> DataFrame:
    return costs.histogram(log(t), {"finish_reason": "finish_reason", "error_code": "error_code"})


@query("by_contract", o.with_ctes("""SELECT contract_variant, count(*) AS cases, round(avg(ok::INT), 6) AS accuracy, round(avg(output_tokens), 6) AS mean_output_tokens, max(output_tokens) AS max_output_tokens FROM rl GROUP BY 1"""))
def by_contract(t: Tables) -> DataFrame:
    return log(t).groupBy("contract_variant").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(costs.correct().cast("int")), 6).alias("accuracy"),
        F.round(F.avg("output_tokens"), 6).alias("mean_output_tokens"), F.max("output_tokens").alias("max_output_tokens"))


@query("request_accuracy_by_dimension", o.with_ctes(" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c}::VARCHAR AS value, count(*) AS cases, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy FROM rl GROUP BY 2"
    for d, c in (("language", "language"), ("class", "expected_sentiment"), ("difficulty", "difficulty"), ("short", "short_text")))))
def request_accuracy_by_dimension(t: Tables) -> DataFrame:
    cases = log(t).withColumn("is_correct", costs.correct())
    return ev.accuracy_by_dimensions(cases, {"language": F.col("language"), "class": F.col("expected_sentiment"),
                                             "difficulty": F.col("difficulty"), "short": F.col("short_text")})


_GATE_SQL = {"accuracy": "avg(ok::INT)", **{f"language_{x}": f"avg(ok::INT) FILTER (NOT short_text AND language = '{x}')" for x in C.TRANSLATABLE_LANGUAGES},
             "short_text": "avg(ok::INT) FILTER (short_text)", "neutral": "avg(ok::INT) FILTER (expected_sentiment = 'Neutro')",
             "truncations": "count(*) FILTER (error_code = 'completion_truncated' OR finish_reason = 'length')::DOUBLE",
             "schema_errors": "count(*) FILTER (error_code IN ('invalid_json', 'invalid_schema', 'invalid_sentiment'))::DOUBLE", "success": "avg(success::INT)"}


@query("quality_gate", o.with_ctes(" UNION ALL ".join(
    f"SELECT '{name}' AS gate, round(coalesce({_GATE_SQL[name]}, 0), 6) AS value, {float(bound)}::DOUBLE AS bound, coalesce({_GATE_SQL[name]}, 0) {'=' if sign == '==' else sign} {bound} AS passed FROM rl"
    for name, _, sign, bound in costs.GATES)))
def quality_gate(t: Tables) -> DataFrame:
    return costs.quality_gate(log(t))


@query("paired_architectures", o.with_ctes("""SELECT a.case_id, a.expected_sentiment AS expected_a, a.sentiment AS sentiment_a, a.local_sentiment AS local_a, a.success AS success_a,
    b.expected_sentiment AS expected_b, b.sentiment AS sentiment_b, b.local_sentiment AS local_b, b.success AS success_b FROM rl_last a JOIN rl_last b ON a.case_id = b.case_id AND a.architecture = 'A' AND b.architecture = 'B'"""))
def paired_architectures(t: Tables) -> DataFrame:
    return costs.paired(log(t))


o.define("arch_final", """SELECT *, CASE WHEN architecture = 'B' OR success THEN sentiment ELSE local_sentiment END AS final_, success OR architecture = 'A' AS judged FROM rl_last""")


@query("architecture_summary", o.with_ctes("""SELECT architecture, count(*) AS cases, count(*) FILTER (judged) AS evaluated, round(avg((coalesce(final_ = expected_sentiment, false))::INT) FILTER (judged), 6) AS accuracy_on_evaluated,
    round(avg((coalesce(final_ = expected_sentiment, false))::INT), 6) AS end_to_end_accuracy, count(*) FILTER (NOT success) AS failures, """ + ", ".join(
    f"round(avg((coalesce(final_ = expected_sentiment, false))::INT) FILTER (judged AND expected_sentiment = '{c}'), 6) AS accuracy_{s}" for c, s in C.CLASS_SLUGS.items()) + " FROM arch_final GROUP BY 1"))
def architecture_summary(t: Tables) -> DataFrame:
    return costs.architecture_summary(log(t))


@query("translation_effect", o.with_ctes("""SELECT language, count(*) AS cases, count(*) FILTER (local_sentiment <> coalesce(sentiment, local_sentiment)) AS label_changed,
    round(count(*)::DOUBLE / count(DISTINCT case_id), 6) AS calls_per_comment, round(sum(pacing_wait_seconds), 4) AS wait_total_seconds, max(pacing_wait_seconds) AS wait_max_seconds FROM rl GROUP BY 1"""))
def translation_effect(t: Tables) -> DataFrame:
    """Per (language, case) first, so distinct cases need no second shuffle of the log."""
    changed = F.col("local_sentiment") != F.coalesce("sentiment", "local_sentiment")
    per_case = log(t).groupBy("language", "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(changed).alias("changed"), F.sum("pacing_wait_seconds").alias("wait"), F.max("pacing_wait_seconds").alias("longest"))
    return per_case.groupBy("language").agg(
        F.sum("n").alias("cases"), F.sum("changed").alias("label_changed"), F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("calls_per_comment"),
        F.round(F.sum("wait"), 4).alias("wait_total_seconds"), F.max("longest").alias("wait_max_seconds"))


@query("merge_recovered", o.with_ctes("""SELECT origin, count(*) AS cases, count(*) FILTER (ok) AS correct FROM (
    SELECT 'previous' AS origin, ok FROM rl WHERE architecture = 'A' AND event_id % 6 = 0 AND success UNION ALL
    SELECT 'recovered', b.ok FROM (SELECT * FROM rl WHERE architecture = 'B' AND event_id % 6 = 1) b
      JOIN (SELECT case_id FROM rl WHERE architecture = 'A' AND event_id % 6 = 0 AND NOT success) p USING (case_id)) GROUP BY 1"""))
def merge_recovered(t: Tables) -> DataFrame:
    """First tries of A, then the first try of B for the cases A failed."""
    first = log(t).groupBy("case_id", "architecture").agg(F.min_by(F.struct("success", "sentiment", "expected_sentiment"), "event_id").alias("r")).select("case_id", "architecture", "r.*")
    previous, again = first.filter("architecture = 'A'"), first.filter("architecture = 'B'")
    return costs.merge_recovered(previous, again.join(previous.filter("NOT success").select("case_id"), "case_id", "left_semi"))


# --- pacing -----------------------------------------------------------------------------

_W = 62_000_000
o.define("ps0", "SELECT event_id, provider_key, epoch_us(ts) AS a, row_number() OVER (PARTITION BY provider_key ORDER BY ts, event_id) - 1 AS i FROM request_log")
o.define("ps1", f"SELECT *, {_W} * (i // 5) + max(a - {_W} * (i // 5)) OVER (PARTITION BY provider_key, i % 5 ORDER BY i) AS s FROM ps0")


@query("request_schedule", o.with_ctes("SELECT event_id, provider_key, i AS position, round((s - a) / 1000000.0::DOUBLE, 6) AS wait_seconds FROM ps1"))
def request_schedule(t: Tables) -> DataFrame:
    planned = pacing.schedule(log(t).select("event_id", "provider_key", "ts"), ["provider_key"], "ts", "event_id")
    return planned.select("event_id", "provider_key", "position", F.round("wait_seconds", 6).alias("wait_seconds"))


@query("rate_audit", o.with_ctes(f"""SELECT event_id, provider_key, count(*) OVER (PARTITION BY provider_key ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS requests_in_window_before FROM request_log"""))
def rate_audit(t: Tables) -> DataFrame:
    rows = log(t).select("event_id", "provider_key", "ts")
    return pacing.requests_in_window(rows, ["provider_key"], "ts", 3600.0, 0.0).select("event_id", "provider_key", "requests_in_window_before")


_NOW = "2024-01-30 23:58:00"


@query("cooldown_remaining", o.with_ctes(f"SELECT provider_key, round(greatest(0, 61.0::DOUBLE - (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(max(ts))) / 1000000.0::DOUBLE), 6) AS cooldown_seconds FROM request_log GROUP BY 1"))
def cooldown_remaining(t: Tables) -> DataFrame:
    return pacing.cooldown(log(t), ["provider_key"], "ts", F.lit(_NOW).cast("timestamp"))
