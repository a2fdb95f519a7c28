"""Streaming twins run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake.durable import scratch
from vozlake.operators import routing
from vozlake.operators.scoring import LinearModel
from vozlake.plans import oracle as o
from vozlake.plans.model_queries import fitted
from vozlake.plans.registry import Tables, query
from vozlake.streaming import jobs

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
_DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("stream_journal", "SELECT event_id, user_id, event_type, value FROM events WHERE value >= 1")
def stream_journal(t: Tables) -> DataFrame:
    """Arriving events, incomplete ones held back, appended exactly once."""
    return _appended(t, jobs.journal(_records(t), _REQUIRED), "stream-journal")


@query("stream_quarantine", """SELECT event_id, user_id, concat_ws('|', CASE WHEN event_type IS NULL THEN 'event_type' END, 'value') AS missing FROM events WHERE NOT coalesce(value >= 1, false)""")
def stream_quarantine(t: Tables) -> DataFrame:
    """The events that the journal holds back, and what they lack."""
    return _appended(t, jobs.quarantine(_records(t), _REQUIRED).select("event_id", "user_id", "missing"), "stream-quarantine")


_REQUIRED = ("event_id", "event_type", "value")


def _records(t: Tables) -> DataFrame:
    events = jobs.read_table_stream(t.spark, t.path("events"), _EVENTS)
    return events.select("event_id", "user_id", "event_type", F.when(F.col("value") >= 1, F.col("value")).alias("value"))


def _appended(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    path = scratch(t.spark, name)
    jobs.finish(jobs.append(stream, path + "/data", path + "/checkpoint"))
    return t.spark.read.parquet(path + "/data")


@query("stream_latest_state", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def stream_latest_state(t: Tables) -> DataFrame:
    events = jobs.read_table_stream(t.spark, t.path("events"), _EVENTS).select("user_id", "event_type", "event_id", "value")
    path = scratch(t.spark, "stream-latest")
    jobs.finish(jobs.latest_state(events, ["user_id", "event_type"], "event_id", path + "/data", path + "/checkpoint"))
    return jobs.read_latest(t.spark, path + "/data", ["user_id", "event_type"], "event_id")


@query("stream_rate", """WITH w AS (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS s FROM events)
    SELECT user_id, epoch(s)::BIGINT AS window_start, count(*) AS requests FROM w GROUP BY 1, s HAVING count(*) > 1 AND s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def stream_rate(t: Tables) -> DataFrame:
    """Users above one event per sliding hour; only windows the watermark has closed."""
    events = jobs.read_table_stream(t.spark, t.path("events"), _EVENTS).select("user_id", "ts")
    alerts = jobs.rate_alerts(events, "user_id", "ts", 1, "1 hour", "30 minutes", "10 minutes")
    path = scratch(t.spark, "stream-rate")
    jobs.finish(jobs.append(alerts, path + "/data", path + "/checkpoint"))
    return t.spark.read.parquet(path + "/data").select("user_id", F.unix_timestamp("window_start").alias("window_start"), "requests")


@query("stream_rate_lookback", """WITH w AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts)
      - count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS requests FROM events)
    SELECT user_id, epoch_us(ts) AS at_us, requests FROM w WHERE requests > 1 AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def stream_rate_lookback(t: Tables) -> DataFrame:
    """Every event that another of its user precedes by less than an hour; only hours the watermark has closed."""
    events = jobs.read_table_stream(t.spark, t.path("events"), _EVENTS).select("user_id", "ts")
    path = scratch(t.spark, "stream-lookback")
    jobs.finish(jobs.append(jobs.rate_lookback(events, "user_id", "ts", 1, 3600), path + "/data", path + "/checkpoint"))
    return t.spark.read.parquet(path + "/data").select("user_id", F.unix_micros("ts").alias("at_us"), "requests")


@query("stream_rate_ring", """SELECT user_id, epoch_us(ts) AS at_us, epoch_us(before + INTERVAL 24 HOUR) AS until_us FROM
    (SELECT user_id, ts, lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before > ts - INTERVAL 24 HOUR""")
def stream_rate_ring(t: Tables) -> DataFrame:
    """Every event that comes when two others of its user are less than a day old, also the last ones."""
    events = jobs.read_table_stream(t.spark, t.path("events"), _EVENTS).select("user_id", "ts")
    path = scratch(t.spark, "stream-ring")
    jobs.finish(jobs.append_keyed(jobs.rate_ring(events, "user_id", "ts", 2, 86_400), path + "/data", path + "/checkpoint"))
    return t.spark.read.parquet(path + "/data").select("user_id", F.unix_micros("ts").alias("at_us"), F.unix_micros("until").alias("until_us"))


@query("stream_scoring", o.with_ctes("SELECT doc_id, sentiment, confidence, reasons <> '' AS should_review FROM routed"), scores="confidence")
def stream_scoring(t: Tables) -> DataFrame:
    arriving = jobs.read_table_stream(t.spark, t.path("documents"), _DOCUMENTS).select("doc_id", "text")
    scored = routing.route(jobs.score_stream(arriving)).select("doc_id", "sentiment", "confidence", "should_review")
    path = scratch(t.spark, "stream-scoring")
    jobs.finish(jobs.append(scored, path + "/data", path + "/checkpoint"))
    return t.spark.read.parquet(path + "/data")


@query("stream_scoring_versions", o.with_ctes("""SELECT doc_id, 1::BIGINT AS model_version, sentiment, confidence, probability_negativo FROM scored WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 2, sentiment, confidence, probability_negativo FROM rs WHERE doc_id % 2 = 1"""), scores="confidence probability_negativo")
def stream_scoring_versions(t: Tables) -> DataFrame:
    """All comments in two arrivals; the model is replaced between them."""
    path = scratch(t.spark, "stream-versions")
    tables = {1: LinearModel.starter().to_table(t.spark), 2: fitted(t)}
    for version, table in tables.items():
        jobs.publish_model(table, path + "/models", version)
        t.documents.filter(F.col("doc_id") % 2 == version - 1).select("doc_id", "text").write.mode("append").parquet(path + "/arriving")
        arriving = jobs.read_stream(t.spark, path + "/arriving", "doc_id bigint, text string", "*.parquet")
        jobs.finish(jobs.score_versions(arriving, path + "/models", path + "/scored", path + "/checkpoint"))
    return jobs.read_scored(t.spark, path + "/scored").select("doc_id", "model_version", "sentiment", "confidence", "probability_negativo")
