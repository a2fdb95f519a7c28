"""Routing, budgets, verdict checks and pacing against sequential simulators."""

import random
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vozlake.functions import payloads
from vozlake.operators import batches, costs, pacing, ranking, routing
from vozlake.operators.routing import HYBRID_ROUTER, Router


def reasons(spark, router, sentiment, confidence, margin=1.0, signals=None):
    df = spark.createDataFrame([(sentiment, confidence, margin)], "sentiment string, confidence double, prediction_margin double")
    extra = F.array(*[F.lit(s) for s in signals]) if signals else None
    return df.select(router.reasons(extra).alias("r")).first().r


def test_thresholds_are_strict(spark):
    assert reasons(spark, Router(), "Neutro", 0.80) == []
    assert reasons(spark, Router(), "Neutro", 0.7999) == ["low_confidence"]
    assert reasons(spark, Router(), "Neutro", 0.7999997) == ["low_confidence"] and reasons(spark, Router(), "Neutro", 0.8) == []
    assert reasons(spark, HYBRID_ROUTER, "Neutro", 0.65) == []
    assert reasons(spark, HYBRID_ROUTER, "Negativo", 0.70) == ["low_confidence:Negativo<0.80"]


def test_margin_and_signals_without_repeats(spark):
    found = reasons(spark, Router(margin_threshold=0.1), "Neutro", 0.9, 0.05, ["small_margin", "language_mismatch"])
    assert found == ["small_margin", "language_mismatch"]


def test_router_settings_are_checked():
    with pytest.raises(ValueError):
        Router(confidence_threshold=1.5)
    with pytest.raises(ValueError):
        Router(class_thresholds={"Negativo": 0.5})


def check(spark, column_of, *cases):
    df = spark.createDataFrame(list(enumerate(cases)), "i int, raw string")
    return [tuple(r.x)[-1] if not hasattr(r.x, "parse_status") else (r.x.error_code, r.x.parse_status)
            for r in df.select("i", column_of(F.col("raw")).alias("x")).orderBy("i").collect()]



def test_review_contract(spark):
    got = check(spark, lambda raw: payloads.review(F.lit(True), F.lit(None).cast("string"), raw),
                '{"sentiment":"Neutro"}', None, "  ", "{", '"Neutro"', "[]", '{"sentiment":"neutro"}', '{"sentiment":"Neutro","x":1}',
                '{"sentiment":"Neutro","confidence":false}', '{"sentiment":"Neutro","confidence":2}', '{"sentiment":"Neutro","confidence":1}',
                '{"sentiment":"Neutro","rationale":["a"]}', '{"sentiment":"Neutro","rationale":null,"confidence":0.5}')
    assert got == [None, "empty_response", "empty_response", "invalid_json", "invalid_sentiment", "invalid_sentiment", "invalid_sentiment",
                   "invalid_sentiment", "invalid_confidence", "invalid_confidence", None, "invalid_rationale", None]


def test_last_of_repeated_keys_counts(spark):
    rows = [('{"sentiment":"Malo","sentiment":"Neutro"}', "Neutro", None), ('{"sentiment":"Neutro","sentiment":"Malo"}', None, "invalid_sentiment"),
            ('{"sentiment":"Neutro","confidence":2,"confidence":0.5}', "Neutro", None), ('{"sentiment":"Neutro","sentiment":"Neutro"', None, "invalid_json")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, raw string")
    got = df.select("i", payloads.review(F.lit(True), F.lit(None).cast("string"), F.col("raw")).alias("x")).orderBy("i").collect()
    assert [(r.x.sentiment, r.x.error_code) for r in got] == [r[1:] for r in rows]


def test_pipeline_off_or_without_detector_reports_no_language(spark):
    docs = spark.createDataFrame([(1, "the service was good and great")], "doc_id long, text string")
    responses = spark.createDataFrame([], "order_key long, kind string, raw string, finish_reason string, transport_error string, "
                                          "provider string, model string, latency_ms double, prompt_tokens int, completion_tokens int")
    columns = ["detected_language", "language_supported", "translation_requested", "translation_state", "translation_error_code"]
    on = batches.multilingual_batch(docs, responses).select(columns).first()
    off = batches.multilingual_batch(docs, responses, enabled=False).select(columns).first()
    missing = batches.multilingual_batch(docs, responses, detector_available=False).select(columns).first()
    assert tuple(on) == ("en", True, True, "fallback_original", "unavailable")
    assert tuple(off) == (None, False, False, "not_needed", None)
    assert tuple(missing) == (None, False, False, "detection_error", "unavailable")


def test_missing_row_and_transport_error_come_first(spark):
    df = spark.createDataFrame([(False, None), (True, "timeout")], "present boolean, transport string")
    got = df.select(payloads.review(F.col("present"), F.col("transport"), F.lit("{")).alias("x")).collect()
    assert [r.x.error_code for r in got] == ["unavailable", "timeout"]


def test_direct_contract(spark):
    def run(finish):
        return lambda raw: payloads.direct(F.lit(True), F.lit(None).cast("string"), raw, F.lit(finish))

    assert check(spark, run("length"), '{"sentiment":"Neutro"}') == ["completion_truncated"]
    assert check(spark, run("stop"), '{"sentiment":"Neutro"}', None, "x", '{"sentiment":"Neutro","confidence":1}', '{"sentiment":"Mixto"}') == [
        None, "invalid_json", "invalid_json", "invalid_schema", "invalid_sentiment"]


def test_translation_contract(spark):
    got = check(spark, lambda raw: payloads.translation(F.lit(True), F.lit(None).cast("string"), raw, F.lit("en")),
                '{"source_language":"en","translated_text":" hola "}', '{"source_language":"pt","translated_text":"x"}',
                '{"source_language":"en","translated_text":" "}', '{"source_language":"en"}', "")
    assert got == [None, "source_mismatch", "empty_translation", "invalid_schema", "empty_response"]


def test_variant_contract(spark):
    long = '{"sentiment":"Neutro","rationale":"' + "a" * 121 + '"}'
    got = check(spark, lambda raw: payloads.variant(F.lit(True), F.lit(None).cast("string"), raw, F.lit("sentiment_rationale")),
                '{"sentiment":"Neutro","rationale":"a"}', long, '{"sentiment":"Neutro"}', "", "{")
    assert got == [(None, "valid"), ("invalid_rationale", "schema_violation"), ("invalid_schema", "schema_violation"),
                   ("empty_response", "empty"), ("invalid_json", "invalid_json")]


def test_hybrid_outcomes(spark):
    rows = [(1, "Negativo", False, False, None), (2, "Negativo", True, False, None), (3, "Negativo", True, True, "{"),
            (4, "Negativo", True, True, '{"sentiment":"Negativo"}'), (5, "Negativo", True, True, '{"sentiment":"Neutro"}')]
    df = spark.createDataFrame(rows, "doc_id int, sentiment string, should_review boolean, granted boolean, r_raw string").withColumns({
        "confidence": F.lit(0.5), "reasons": F.when(F.col("should_review"), F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>")),
        "r_present": F.col("r_raw").isNotNull(), "r_transport_error": F.lit(None).cast("string"), "r_provider": F.lit("p"), "r_model": F.lit("m"),
        "r_latency_ms": F.lit(1.0), "r_finish_reason": F.lit("stop"), "r_prompt_tokens": F.lit(1), "r_completion_tokens": F.lit(1)})
    got = [(r.review_state, r.sentiment, r.review_error_code, r.fallback_used, r.review_reasons) for r in routing.consolidate(df).orderBy("doc_id").collect()]
    assert got == [
        ("local_only", "Negativo", None, False, ""), ("fallback_local", "Negativo", "review_budget_exceeded", True, "low_confidence"),
        ("fallback_local", "Negativo", "invalid_json", True, "low_confidence"), ("reviewed", "Negativo", None, False, "low_confidence"),
        ("disagreement", "Neutro", None, False, "low_confidence")]
    none = [(r.review_state, r.review_error_code) for r in routing.consolidate(df, provider_available=False).orderBy("doc_id").collect()]
    assert none == [("local_only", None)] + [("fallback_local", "unavailable")] * 4


def sequential_budget(items, cap):
    """Each row may spend a translation, then a review; a full budget refuses everything."""
    used, out = 0, []
    for key, translate, review in items:
        t = translate and used < cap
        used += t
        r = review and used < cap
        used += r
        out.append((key, bool(t), bool(r)))
    return out


def test_shared_budget_equals_the_sequential_one(spark):
    rng, rows, expected = random.Random(3), [], {}
    for batch in range(60):
        items = [(k, rng.random() < 0.5, rng.random() < 0.5) for k in range(rng.randint(1, 14))]
        rows += [(batch, *i) for i in items]
        expected[batch] = sequential_budget(items, 5)
    df = spark.createDataFrame(rows, "batch int, k int, t boolean, r boolean")
    marked = routing.grant(df, F.col("t") | F.col("r"), "k", 5, ["batch"], "early")
    judged = routing.shared_grants(marked.filter("early"), F.col("t"), F.col("r"), "k", 5, ["batch"])
    granted = {(r.batch, r.k): (r.translation_granted, r.review_granted) for r in judged.collect()}
    for batch, items in expected.items():
        assert [(k, *granted.get((batch, k), (False, False))) for k, _, _ in items] == items


def test_single_budget_is_the_first_requests_in_key_order(spark):
    df = spark.createDataFrame([(k, k % 3 == 0) for k in range(60)], "k int, asked boolean").repartition(7)
    got = sorted(r.k for r in routing.grant(df, F.col("asked"), "k", 4).filter("granted").collect())
    assert got == [0, 3, 6, 9]


def simulated_schedule(arrivals, capacity, window):
    """A window of start times: wait until a slot frees, then start."""
    kept, out = deque(), []
    for now in arrivals:
        while True:
            while kept and now - kept[0] >= window:
                kept.popleft()
            if len(kept) < capacity:
                break
            now = kept[0] + window
        kept.append(now)
        out.append(now)
    return out


START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_schedule_equals_the_rolling_window(spark):
    rng, rows, expected = random.Random(11), [], {}
    for provider in range(12):
        arrivals = sorted(rng.randint(0, 400) for _ in range(rng.randint(1, 40)))
        starts = simulated_schedule(arrivals, 3, 62)
        expected[provider] = [s - a for s, a in zip(starts, arrivals)]
        rows += [(provider, i, START + timedelta(seconds=a)) for i, a in enumerate(arrivals)]
    df = spark.createDataFrame(rows, "provider int, id int, ts timestamp").repartition(5)
    for partitions in (1, 7):
        planned = pacing.schedule(df, ["provider"], "ts", "id", requests=3, partitions=partitions)
        got = {}
        for r in planned.orderBy("provider", "position").collect():
            got.setdefault(r.provider, []).append(r.wait_seconds)
        assert got == expected


def test_window_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 2), i, rng.randint(0, 300)) for i in range(120)]
    df = spark.createDataFrame([(p, i, START + timedelta(seconds=s)) for p, i, s in rows], "provider int, id int, ts timestamp")
    got = {r.id: r.requests_in_window_before for r in pacing.requests_in_window(df, ["provider"], "ts").collect()}
    want = {i: sum(1 for q, _, x in rows if q == p and s - 62 < x <= s) - 1 for p, i, s in rows}
    assert got == want


def test_cooldown(spark):
    df = spark.createDataFrame([("a", START), ("b", START - timedelta(seconds=90))], "p string, done timestamp")
    now = F.lit("2024-01-01 00:00:11").cast("timestamp")
    assert {r.p: r.cooldown_seconds for r in pacing.cooldown(df, ["p"], "done", now).collect()} == {"a": 50.0, "b": 0.0}


def test_scan_over_many_partitions_with_one_heavy_group(spark):
    rng = random.Random(2)
    rows = [("heavy" if i % 3 == 0 else f"g{i % 7}", i, rng.randint(0, 50)) for i in range(600)] + [(None, 1000, 4), (None, 1001, 5)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(6)
    order = [F.col("k").asc()]
    placed = ranking.place(df, ["g"], order, 9)
    got = {(r.g, r.k): (r.total, r.top) for r in ranking.scan(placed, ["g"], order, {"total": F.col("v")}, {"top": F.col("v")}).collect()}
    state, want = {}, {}
    for g, k, v in sorted(rows, key=lambda x: x[1]):
        s, m = state.get(g, (0, -1))
        state[g] = (s + v, max(m, v))
        want[(g, k)] = state[g]
    assert got == want


def test_two_p95_definitions(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 21)], "latency_ms double")
    r = costs.latency_summary(df).first()
    assert (r.latency_p95, r.latency_p95_lower, r.latency_median) == (19.05, 19.0, 10.5)


def test_cost_is_null_only_without_tokens(spark):
    df = spark.createDataFrame([(None, None), (10, None), (None, 10)], "input_tokens int, output_tokens int")
    assert [r.c and round(r.c, 9) for r in df.select(costs.request_cost().alias("c")).collect()] == [None, 3.5e-6, 7.5e-6]


def test_hybrid_text_columns_survive(spark):
    docs = spark.createDataFrame([(1, "servicio terrible", "x"), (2, "a", "y")], "doc_id int, text string, extra string")
    responses = spark.createDataFrame([], "order_key int, kind string, raw string, finish_reason string, transport_error string, provider string, model string, "
                                          "latency_ms double, prompt_tokens int, completion_tokens int")
    got = batches.hybrid_batch(docs, responses, keep=["extra", "text"]).collect()
    assert [(r.doc_id, r.extra, r.text) for r in got] == [(1, "x", "servicio terrible")]


def test_latest_record_wins(spark):
    df = spark.createDataFrame([("a", "A", 1, "x"), ("a", "A", 3, "z"), ("a", "B", 2, "y")], "case_id string, architecture string, seq int, v string")
    assert sorted((r.architecture, r.v) for r in costs.latest_records(df, ["case_id", "architecture"], "seq").collect()) == [("A", "z"), ("B", "y")]
