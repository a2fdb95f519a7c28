"""Queries over routing, budgets, verdict checks and whole-batch jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions import payloads
from vozlake.functions import text as tx
from vozlake.operators import batches, evaluation as ev, metrics, routing, scoring
from vozlake.plans import oracle as o
from vozlake.plans.model_queries import scored
from vozlake.plans.registry import Tables, query
from vozlake.plans.text_queries import comments, with_tokens

CAP = C.MAX_REVIEWS_PER_BATCH
BATCH = ["source"]

# --- routing rules ------------------------------------------------------------------


@query("route_confidence", o.with_ctes("SELECT doc_id, confidence < 0.8 AS should_review, CASE WHEN confidence < 0.8 THEN 'low_confidence' ELSE '' END AS reasons FROM scored"))
def route_confidence(t: Tables) -> DataFrame:
    routed = routing.route(scored(t), routing.Router())
    return routed.select("doc_id", "should_review", F.array_join("reasons", "|").alias("reasons"))


_CLASS_RULE = "CASE " + " ".join(
    f"WHEN {{s}} = '{c}' AND {{c}} < {x} THEN 'low_confidence:{c}<{x:.2f}'" for c, x in C.CLASS_THRESHOLDS.items()) + " ELSE '' END"


def class_rule(sentiment: str = "sentiment", confidence: str = "confidence") -> str:
    return _CLASS_RULE.replace("{s}", sentiment).replace("{c}", confidence)


o.define("routed", f"SELECT *, {class_rule()} AS reasons FROM scored")


@query("route_class_threshold", o.with_ctes("SELECT doc_id, sentiment, reasons <> '' AS should_review, reasons FROM routed"))
def route_class_threshold(t: Tables) -> DataFrame:
    return routing.route(scored(t)).select("doc_id", "sentiment", "should_review", F.array_join("reasons", "|").alias("reasons"))


@query("route_margin", o.with_ctes("""SELECT doc_id, confidence < 0.8 OR prediction_margin < 0.2 AS should_review,
    concat_ws('|', CASE WHEN confidence < 0.8 THEN 'low_confidence' END, CASE WHEN prediction_margin < 0.2 THEN 'small_margin' END) AS reasons FROM scored"""))
def route_margin(t: Tables) -> DataFrame:
    routed = routing.route(scored(t), routing.Router(margin_threshold=0.20))
    return routed.select("doc_id", "should_review", F.array_join("reasons", "|").alias("reasons"))


def upstream_signals() -> F.Column:
    """Signals known before routing; one name is outside the contract."""
    return F.array_compact(F.array(
        F.when(F.col("n_features") == 0, F.lit("possible_out_of_domain")),
        F.when(F.col("lang") != "es", F.lit("language_mismatch")),
        F.when(F.col("prediction_margin") < 0.1, F.lit("small_margin")),
        F.when(F.col("doc_id") % 10 == 3, F.lit("operator_hunch"))))


@query("route_signals", o.with_ctes("""SELECT doc_id, concat_ws('|', CASE WHEN confidence < 0.8 THEN 'low_confidence' END, CASE WHEN prediction_margin < 0.05 THEN 'small_margin' END,
    CASE WHEN n_features = 0 THEN 'possible_out_of_domain' END, CASE WHEN lang <> 'es' THEN 'language_mismatch' END,
    CASE WHEN prediction_margin >= 0.05 AND prediction_margin < 0.1 THEN 'small_margin' END) AS reasons,
    CASE WHEN doc_id % 10 = 3 THEN 'operator_hunch' ELSE '' END AS unsupported FROM scored"""))
def route_signals(t: Tables) -> DataFrame:
    """Upstream signals joined to rule reasons; names outside the contract are reported."""
    rows = scored(t).withColumn("signals", upstream_signals())
    bad = routing.unsupported_signals(F.col("signals"))
    routed = routing.route(rows, routing.Router(margin_threshold=0.05), F.array_except("signals", bad))
    return routed.select("doc_id", F.array_join("reasons", "|").alias("reasons"), F.array_join(bad, "|").alias("unsupported"))


@query("route_decision", o.with_ctes("""SELECT doc_id, reasons <> '' AS should_review, reasons, confidence AS local_confidence, prediction_margin, sentiment AS local_class, second_best_class FROM routed"""), scores="local_confidence prediction_margin")
def route_decision(t: Tables) -> DataFrame:
    return routing.route(scored(t)).select(
        "doc_id", "should_review", F.array_join("reasons", "|").alias("reasons"), F.col("confidence").alias("local_confidence"),
        "prediction_margin", F.col("sentiment").alias("local_class"), "second_best_class")


@query("estimate_reviews", o.with_ctes(f"""SELECT s.source, s.requested, least(s.requested, {CAP}) AS allowed, d.dropped FROM
    (SELECT source, count(*) FILTER (reasons <> '') AS requested FROM routed GROUP BY 1) s JOIN
    (SELECT source, count(*) FILTER (length(t) < 2) AS dropped FROM stripped GROUP BY 1) d USING (source)"""))
def estimate_reviews(t: Tables) -> DataFrame:
    """Requested, allowed and dropped from one scan, without any call."""
    text = tx.prepared(F.col("text"))
    every = scoring.score(t.documents.select("doc_id", "source", text.alias("text")))
    valid = tx.is_valid(F.col("text"))
    routed = routing.route(every)
    asked = F.count_if(F.col("should_review") & valid)
    return routed.groupBy("source").agg(asked.alias("requested"), F.least(asked, F.lit(CAP)).alias("allowed"), F.count_if(~valid).alias("dropped"))


@query("estimate_translations", o.with_ctes("""SELECT source, count(*) FILTER (language_status = 'detected' AND detected_language IN ('en', 'pt', 'it')) AS requested
    FROM lang_detected JOIN prep USING (doc_id) GROUP BY 1"""))
def estimate_translations(t: Tables) -> DataFrame:
    found = scoring.detect_language(comments(t))
    asked = (F.col("language_status") == "detected") & F.col("detected_language").isin(list(C.TRANSLATABLE_LANGUAGES))
    return found.groupBy("source").agg(F.count_if(asked).alias("requested"))


o.define("hy_rank", """SELECT *, CASE WHEN reasons <> '' THEN row_number() OVER (PARTITION BY source, reasons <> '' ORDER BY doc_id) END AS turn FROM routed""")


def requests(t: Tables) -> DataFrame:
    """The narrow request trace, stored once: a grant reads it twice."""
    return cut(routing.route(scored(t)).select("doc_id", "source", "should_review"))


@query("budget_grant", o.with_ctes(f"SELECT doc_id, source, reasons <> '' AS should_review, coalesce(turn <= {CAP}, false) AS granted FROM hy_rank"))
def budget_grant(t: Tables) -> DataFrame:
    return routing.grant(requests(t), F.col("should_review"), "doc_id", CAP, BATCH).select("doc_id", "source", "should_review", "granted")


@query("budget_grant_single_batch", o.with_ctes("""SELECT doc_id, reasons <> '' AS should_review, reasons <> '' AND row_number() OVER (PARTITION BY reasons <> '' ORDER BY doc_id) <= 25 AS granted FROM routed"""))
def budget_grant_single_batch(t: Tables) -> DataFrame:
    """One budget for the whole table: a top-k, never a global sort."""
    return routing.grant(requests(t), F.col("should_review"), "doc_id", CAP).select("doc_id", "should_review", "granted")


@query("estimated_cost", o.with_ctes(f"""SELECT source, least(count(*) FILTER (reasons <> ''), {CAP}) AS allowed, round(least(count(*) FILTER (reasons <> ''), {CAP}) * 0.000178::DOUBLE, 6) AS estimated_cost_usd FROM routed GROUP BY 1"""))
def estimated_cost(t: Tables) -> DataFrame:
    allowed = F.least(F.count_if("should_review"), F.lit(CAP))
    return routing.route(scored(t)).groupBy("source").agg(allowed.alias("allowed"), F.round(allowed * C.REVIEW_COST_USD, 6).alias("estimated_cost_usd"))


# --- verdict checks --------------------------------------------------------------------

_IN_CLASS = f"coalesce(json_type({{j}}, '$.sentiment') = 'VARCHAR' AND json_extract_string({{j}}, '$.sentiment') IN ({o.words(C.CLASSES)}), false)"
_NUMERIC = "('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT')"
_BLANK = o.strip("coalesce(raw, '')") + " = ''"


def _keys_sql(*names: str) -> str:
    return f"json_type(j) = 'OBJECT' AND list_sort(json_keys(j)) = [{o.words(sorted(names))}]"


o.define("asked_keys", "SELECT doc_id AS order_key, lang, doc_id % 2 AS parity FROM documents")
for _kind in ("sentiment_review", "direct_review", "translation"):
    o.define(f"raw_{_kind}", f"""SELECT k.order_key, k.lang, k.parity, r.order_key IS NOT NULL AS present, r.raw, r.finish_reason, r.transport_error, r.provider, r.model, r.latency_ms,
        r.prompt_tokens, r.completion_tokens, CASE WHEN json_valid(r.raw) THEN r.raw END AS j FROM asked_keys k LEFT JOIN responses r ON r.order_key = k.order_key AND r.kind = '{_kind}'""")
o.define("rv0", f"""SELECT *, CASE WHEN NOT present THEN 'unavailable' WHEN transport_error IS NOT NULL THEN transport_error WHEN {_BLANK} THEN 'empty_response'
    WHEN j IS NULL THEN 'invalid_json'
    WHEN json_type(j) <> 'OBJECT' OR len(list_filter(json_keys(j), lambda k: k NOT IN ('sentiment', 'confidence', 'rationale'))) > 0 OR NOT {_IN_CLASS.format(j='j')} THEN 'invalid_sentiment'
    WHEN coalesce(json_type(j, '$.confidence') <> 'NULL' AND (json_type(j, '$.confidence') NOT IN {_NUMERIC} OR NOT coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1, false)), false) THEN 'invalid_confidence'
    WHEN coalesce(json_type(j, '$.rationale') NOT IN ('NULL', 'VARCHAR'), false) THEN 'invalid_rationale' END AS error_code FROM raw_sentiment_review""")
o.define("rv", f"""SELECT *, error_code IS NULL AS success, CASE WHEN error_code IS NULL THEN json_extract_string(j, '$.sentiment') END AS verdict,
    CASE WHEN error_code IS NULL THEN try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) END AS verdict_confidence,
    CASE WHEN error_code IS NULL THEN nullif({o.strip("json_extract_string(j, '$.rationale')")}[1:240], '') END AS rationale FROM rv0""")
o.define("rd0", f"""SELECT *, CASE WHEN NOT present THEN 'unavailable' WHEN transport_error IS NOT NULL THEN transport_error WHEN finish_reason = 'length' THEN 'completion_truncated'
    WHEN j IS NULL THEN 'invalid_json' WHEN NOT ({_keys_sql('sentiment')}) THEN 'invalid_schema' WHEN NOT {_IN_CLASS.format(j='j')} THEN 'invalid_sentiment' END AS error_code FROM raw_direct_review""")
o.define("rd", "SELECT *, error_code IS NULL AS success, CASE WHEN error_code IS NULL THEN json_extract_string(j, '$.sentiment') END AS verdict FROM rd0")


def _translation_sql(language: str) -> str:
    return f"""CASE WHEN NOT present THEN 'unavailable' WHEN transport_error IS NOT NULL THEN transport_error WHEN {_BLANK} THEN 'empty_response' WHEN j IS NULL THEN 'invalid_json'
    WHEN NOT ({_keys_sql('source_language', 'translated_text')}) THEN 'invalid_schema' WHEN json_extract_string(j, '$.source_language') IS DISTINCT FROM {language} THEN 'source_mismatch'
    WHEN json_type(j, '$.translated_text') <> 'VARCHAR' OR {o.strip("json_extract_string(j, '$.translated_text')")} = '' THEN 'empty_translation' END"""


def responses_for(t: Tables, kind: str, keep=("lang",)) -> DataFrame:
    asked = t.documents.select("doc_id", *keep)
    return routing.attach(asked, t.derived("responses"), kind, "doc_id")


@query("attach_responses", o.with_ctes(f"""SELECT h.doc_id, coalesce(turn <= {CAP}, false) AS granted,
    CASE WHEN turn <= {CAP} THEN r.raw END AS raw, CASE WHEN turn <= {CAP} THEN r.provider END AS provider, CASE WHEN turn <= {CAP} THEN r.latency_ms END AS latency_ms,
    CASE WHEN turn <= {CAP} THEN r.prompt_tokens END AS prompt_tokens, CASE WHEN turn <= {CAP} THEN r.completion_tokens END AS completion_tokens,
    turn <= {CAP} AND (r.prompt_tokens IS NOT NULL OR r.completion_tokens IS NOT NULL) IS TRUE AS has_usage
    FROM hy_rank h JOIN raw_sentiment_review r ON r.order_key = h.doc_id""").replace("turn <= 25 AND (r.prompt", "coalesce(turn <= 25, false) AND (r.prompt"))
def attach_responses(t: Tables) -> DataFrame:
    granted = routing.grant(requests(t), F.col("should_review"), "doc_id", CAP, BATCH).select("doc_id", "granted")
    answered = routing.attach_granted(granted, t.derived("responses"), "sentiment_review", "doc_id", "granted", "")
    return answered.select("doc_id", "granted", "raw", "provider", "latency_ms", "prompt_tokens", "completion_tokens",
                           payloads.usage().isNotNull().alias("has_usage"))


@query("validate_review_json", o.with_ctes("SELECT order_key AS doc_id, success, verdict AS sentiment, verdict_confidence AS confidence, rationale, error_code FROM rv"))
def validate_review_json(t: Tables) -> DataFrame:
    rows = responses_for(t, "sentiment_review")
    return rows.select("doc_id", F.inline_outer(F.array(payloads.review(F.col("r_present"), F.col("r_transport_error"), F.col("r_raw")))))


@query("validate_direct_json", o.with_ctes("SELECT order_key AS doc_id, success, verdict AS sentiment, error_code FROM rd"))
def validate_direct_json(t: Tables) -> DataFrame:
    rows = responses_for(t, "direct_review")
    checked = rows.select("doc_id", F.inline_outer(F.array(payloads.direct(
        F.col("r_present"), F.col("r_transport_error"), F.col("r_raw"), F.col("r_finish_reason")))))
    return checked.select("doc_id", "success", "sentiment", "error_code")


@query("validate_translation_json", o.with_ctes(f"""SELECT doc_id, error_code IS NULL AS success, CASE WHEN error_code IS NULL THEN {o.strip("json_extract_string(j, '$.translated_text')")} END AS translated_text, error_code
    FROM (SELECT order_key AS doc_id, j, {_translation_sql('lang')} AS error_code FROM raw_translation)"""))
def validate_translation_json(t: Tables) -> DataFrame:
    rows = responses_for(t, "translation")
    return rows.select("doc_id", F.inline_outer(F.array(payloads.translation(
        F.col("r_present"), F.col("r_transport_error"), F.col("r_raw"), F.col("lang")))))


o.define("rw0", f"""SELECT *, CASE WHEN parity = 0 THEN 'sentiment_only' ELSE 'sentiment_rationale' END AS contract FROM raw_sentiment_review""")
o.define("rw", f"""SELECT *, CASE WHEN NOT present THEN 'unavailable' WHEN transport_error IS NOT NULL THEN transport_error WHEN {_BLANK} THEN 'empty_response' WHEN j IS NULL THEN 'invalid_json'
    WHEN NOT (CASE WHEN parity = 0 THEN {_keys_sql('sentiment')} ELSE {_keys_sql('sentiment', 'rationale')} END) THEN 'invalid_schema' WHEN NOT {_IN_CLASS.format(j='j')} THEN 'invalid_sentiment'
    WHEN parity = 1 AND NOT coalesce(json_type(j, '$.rationale') = 'VARCHAR' AND length(json_extract_string(j, '$.rationale')) <= 120, false) THEN 'invalid_rationale' END AS error_code FROM rw0""")


@query("validate_variant_json", o.with_ctes(f"""SELECT order_key AS doc_id, contract, error_code IS NULL AS success, error_code,
    CASE WHEN NOT present OR transport_error IS NOT NULL THEN NULL WHEN {_BLANK} THEN 'empty' WHEN j IS NULL THEN 'invalid_json' WHEN error_code IS NOT NULL THEN 'schema_violation' ELSE 'valid' END AS parse_status FROM rw"""))
def validate_variant_json(t: Tables) -> DataFrame:
    contract = F.when(F.col("doc_id") % 2 == 0, "sentiment_only").otherwise("sentiment_rationale")
    rows = responses_for(t, "sentiment_review").withColumn("contract", contract)
    checked = rows.select("doc_id", "contract", F.inline_outer(F.array(payloads.variant(
        F.col("r_present"), F.col("r_transport_error"), F.col("r_raw"), F.col("contract")))))
    return checked.select("doc_id", "contract", "success", "error_code", "parse_status")


# --- hybrid ------------------------------------------------------------------------------

o.define("hy0", f"""SELECT h.doc_id, h.source, h.sentiment AS local_sentiment, h.confidence, h.reasons, h.reasons <> '' AS asked, coalesce(h.turn <= {CAP}, false) AS granted,
    r.success, r.verdict, r.error_code AS code, r.present, r.provider, r.model, r.latency_ms FROM hy_rank h JOIN rv r ON r.order_key = h.doc_id""")
_TRACE = """CASE WHEN answered THEN verdict ELSE local_sentiment END AS sentiment, local_sentiment, confidence AS local_confidence, asked AS review_requested, reasons AS review_reasons,
    CASE WHEN NOT asked THEN 'local_only' WHEN NOT answered THEN 'fallback_local' WHEN verdict = local_sentiment THEN 'reviewed' ELSE 'disagreement' END AS review_state,
    CASE WHEN answered THEN verdict END AS review_sentiment, CASE WHEN asked AND granted AND present THEN provider END AS review_provider, CASE WHEN asked AND granted AND present THEN model END AS review_model,
    CASE WHEN asked AND granted AND present THEN latency_ms END AS review_latency_ms, asked AND NOT answered AS fallback_used,
    CASE WHEN NOT asked THEN NULL WHEN NOT granted THEN 'review_budget_exceeded' WHEN NOT success THEN code END AS review_error_code"""
o.define("hybrid_rows", f"SELECT doc_id, source, confidence, {_TRACE} FROM (SELECT *, asked AND granted AND success AS answered FROM hy0)")
_HYBRID = ["doc_id", "source", "sentiment", "confidence", "local_sentiment", "local_confidence", "review_requested", "review_reasons", "review_state", "review_sentiment",
           "review_provider", "review_model", "review_latency_ms", "fallback_used", "review_error_code"]


def hybrid(t: Tables) -> DataFrame:
    return batches.hybrid_batch(t.documents.select("doc_id", "source", "text"), t.derived("responses"), group_cols=BATCH)


@query("consolidate_hybrid", o.with_ctes("SELECT review_state, review_error_code, fallback_used, sentiment = local_sentiment AS kept_local, count(*) AS n FROM hybrid_rows GROUP BY ALL"))
def consolidate_hybrid(t: Tables) -> DataFrame:
    kept = (F.col("sentiment") == F.col("local_sentiment")).alias("kept_local")
    return hybrid(t).groupBy("review_state", "review_error_code", "fallback_used", kept).agg(F.count(F.lit(1)).alias("n"))


@query("hybrid_batch", o.with_ctes(f"SELECT {', '.join(_HYBRID)} FROM hybrid_rows"), scores="confidence local_confidence")
def hybrid_batch(t: Tables) -> DataFrame:
    return hybrid(t).select(*_HYBRID)


@query("hybrid_batch_no_provider", o.with_ctes("""SELECT doc_id, sentiment, CASE WHEN reasons <> '' THEN 'fallback_local' ELSE 'local_only' END AS review_state,
    CASE WHEN reasons <> '' THEN 'unavailable' END AS review_error_code FROM routed"""))
def hybrid_batch_no_provider(t: Tables) -> DataFrame:
    results = batches.hybrid_batch(t.documents.select("doc_id", "source", "text"), t.derived("responses"), group_cols=BATCH, provider_available=False)
    return results.select("doc_id", "sentiment", "review_state", "review_error_code")


o.define("hybrid_sum", """SELECT source, count(*) FILTER (review_requested) AS review_requested, count(*) FILTER (review_requested AND review_error_code IS DISTINCT FROM 'review_budget_exceeded') AS reviews_attempted,
    count(*) FILTER (review_error_code = 'review_budget_exceeded') AS review_budget_exceeded, count(*) FILTER (review_state = 'local_only') AS local_only, count(*) FILTER (review_state = 'reviewed') AS reviewed,
    count(*) FILTER (review_state = 'disagreement') AS disagreement, count(*) FILTER (review_state = 'fallback_local') AS fallback,
    round(count(*) FILTER (review_requested AND review_error_code IS DISTINCT FROM 'review_budget_exceeded') * 0.000178::DOUBLE, 6) AS estimated_cost_usd FROM hybrid_rows GROUP BY 1""")


@query("state_counts", o.with_ctes("SELECT * FROM hybrid_sum"))
def state_counts(t: Tables) -> DataFrame:
    return routing.hybrid_summary(hybrid(t), BATCH)


@query("state_shares", o.with_ctes("SELECT source, review_state AS state, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS percentage FROM hybrid_rows GROUP BY 1, 2"))
def state_shares(t: Tables) -> DataFrame:
    return metrics.state_shares(hybrid(t), "review_state", BATCH)


@query("provider_status", o.with_ctes("""SELECT doc_id, CASE WHEN review_state = 'local_only' THEN 'not_requested' WHEN review_state IN ('reviewed', 'disagreement') THEN 'reviewed'
    ELSE coalesce(review_error_code, 'provider_error') END AS provider_status FROM hybrid_rows"""))
def provider_status(t: Tables) -> DataFrame:
    return hybrid(t).select("doc_id", routing.provider_status(F.col("review_state"), F.col("review_error_code")).alias("provider_status"))


@query("hybrid_benchmark", o.with_ctes("""SELECT doc_id, t.expected, local_sentiment, sentiment AS hybrid_prediction, review_state, local_sentiment = t.expected AS local_correct, sentiment = t.expected AS hybrid_correct
    FROM hybrid_rows JOIN truth t USING (doc_id)"""))
def hybrid_benchmark(t: Tables) -> DataFrame:
    rows = hybrid(t).join(t.derived("truth"), "doc_id")
    return rows.select("doc_id", "expected", "local_sentiment", F.col("sentiment").alias("hybrid_prediction"), "review_state",
                       (F.col("local_sentiment") == F.col("expected")).alias("local_correct"), (F.col("sentiment") == F.col("expected")).alias("hybrid_correct"))


STATE_LABELS = {"local_only": "Modelo local", "reviewed": "Confirmado", "disagreement": "Corregido", "fallback_local": "Respaldo local"}
ERROR_LABELS = {"review_budget_exceeded": "Presupuesto agotado", "timeout": "Tiempo agotado", "unavailable": "No disponible"}
UNKNOWN_STATE = "Estado desconocido"


@query("display_labels", o.with_ctes(f"""SELECT doc_id, CASE review_state {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_LABELS.items() if k != 'disagreement')} ELSE '{UNKNOWN_STATE}' END AS state_label,
    CASE review_error_code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ERROR_LABELS.items())} ELSE review_error_code END AS error_label, round(confidence * 100, 6) AS confidence_percent FROM hybrid_rows"""))
def display_labels(t: Tables) -> DataFrame:
    """State and error codes to labels; unknown states fall back, unknown errors keep their code."""
    return routing_display(hybrid(t), {k: v for k, v in STATE_LABELS.items() if k != "disagreement"}, ERROR_LABELS)


def routing_display(results: DataFrame, states: dict[str, str], errors: dict[str, str]) -> DataFrame:
    def mapped(column: str, labels: dict[str, str]):
        table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        return F.try_element_at(table, F.coalesce(F.col(column), F.lit("")))

    return results.select(
        "doc_id", F.coalesce(mapped("review_state", states), F.lit(UNKNOWN_STATE)).alias("state_label"),
        F.coalesce(mapped("review_error_code", errors), F.col("review_error_code")).alias("error_label"),
        F.round(F.col("confidence").try_cast("double") * 100, 6).alias("confidence_percent"))


# --- multilingual and direct ---------------------------------------------------------------

o.define("ml_in", f"""SELECT r.doc_id, r.source, r.sentiment, r.confidence, r.reasons, d.detected_language, d.language_status,
    coalesce(d.language_status = 'detected' AND d.detected_language <> 'es', false) AS t FROM routed r JOIN lang_detected d USING (doc_id)""")
o.define("ml_tr", f"""SELECT m.doc_id, {_translation_sql('m.detected_language')} AS t_code, w.present AS t_present, w.provider AS t_provider, w.model AS t_model, w.latency_ms AS t_latency,
    {o.strip("json_extract_string(j, '$.translated_text')")} AS ttext FROM ml_in m JOIN raw_translation w ON w.order_key = m.doc_id""")
o.define("ml_txt", "SELECT doc_id, ttext FROM ml_tr WHERE t_code IS NULL")
for _key, _cte in o.score_ctes("ml_txt", "doc_id", "ttext", "mt").items():
    o.define(_key, _cte)
o.define("ml_cand", f"""SELECT *, CASE WHEN t OR reasons <> '' THEN row_number() OVER (PARTITION BY source, t OR reasons <> '' ORDER BY doc_id) END AS turn FROM ml_in""")
o.define("ml_wish", f"""SELECT c.*, x.t_code, x.t_present, x.t_provider, x.t_model, x.t_latency, s.sentiment AS alt_sentiment, s.confidence AS alt_confidence,
    {class_rule('s.sentiment', 's.confidence')} AS alt_reasons, coalesce(c.t AND c.turn <= {CAP} AND x.t_code IS NULL, false) AS usable
    FROM ml_cand c JOIN ml_tr x USING (doc_id) LEFT JOIN mt s USING (doc_id)""")
o.define("ml_used", f"""SELECT *, CASE WHEN turn <= {CAP} THEN coalesce(sum(t::INT + (CASE WHEN usable THEN alt_reasons ELSE reasons END <> '')::INT)
    OVER (PARTITION BY source, turn <= {CAP} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE {CAP} END AS used FROM ml_wish""")
o.define("ml_grant", f"""SELECT *, t AND used < {CAP} AS t_given, used + t::INT < {CAP} AS r_room FROM ml_used""")
o.define("ml_final", f"""SELECT g.*, CASE WHEN usable AND t_given THEN alt_sentiment ELSE sentiment END AS local_sentiment, CASE WHEN usable AND t_given THEN alt_confidence ELSE g.confidence END AS local_conf,
    CASE WHEN usable AND t_given THEN alt_reasons ELSE reasons END AS why FROM ml_grant g""")
o.define("ml_rows", f"""SELECT doc_id, source, detected_language, language_status = 'detected' AS language_supported, t AS translation_requested,
    CASE WHEN language_status = 'unknown' THEN 'detection_error' WHEN language_status = 'unsupported' THEN 'unsupported_language' WHEN NOT t THEN 'not_needed' WHEN t_given AND t_code IS NULL THEN 'translated' ELSE 'fallback_original' END AS translation_state,
    CASE WHEN language_status = 'unknown' THEN 'undetectable_text' WHEN t AND NOT t_given THEN 'external_budget_exceeded' WHEN t THEN t_code END AS translation_error_code,
    CASE WHEN t_given AND t_present THEN t_latency END AS translation_latency_ms, t_given, granted, local_conf AS confidence,
    {_TRACE.replace('confidence AS local_confidence', 'local_conf AS local_confidence').replace('reasons AS review_reasons', 'why AS review_reasons')}
    FROM (SELECT f.*, why <> '' AS asked, why <> '' AND r_room AS granted, r.success, r.verdict, r.error_code AS code, r.present, r.provider, r.model, r.latency_ms, why <> '' AND r_room AND r.success AS answered
      FROM (SELECT * EXCLUDE (sentiment, confidence, reasons) FROM ml_final) f JOIN rv r ON r.order_key = f.doc_id)""")


def multilingual(t: Tables) -> DataFrame:
    return batches.multilingual_batch(t.documents.select("doc_id", "source", "text"), t.derived("responses"), group_cols=BATCH)


_PREP = ["doc_id", "detected_language", "language_supported", "translation_requested", "translation_state", "translation_error_code", "translation_latency_ms"]


@query("shared_budget_grant", o.with_ctes("SELECT doc_id, source, t_given AS translation_granted, granted AS review_granted FROM ml_rows"))
def shared_budget_grant(t: Tables) -> DataFrame:
    return multilingual(t).select("doc_id", "source", "translation_granted", F.col("call_made").alias("review_granted"))


@query("prepare_multilingual", o.with_ctes(f"SELECT {', '.join(_PREP)} FROM ml_rows"))
def prepare_multilingual(t: Tables) -> DataFrame:
    return multilingual(t).select(*_PREP)


_MULTI = [c for c in _HYBRID] + ["detected_language", "translation_state", "translation_error_code"]


@query("multilingual_batch", o.with_ctes(f"SELECT {', '.join(_MULTI)} FROM ml_rows"), scores="confidence local_confidence")
def multilingual_batch(t: Tables) -> DataFrame:
    return multilingual(t).select(*_MULTI)


@query("call_breakdown", o.with_ctes(f"""SELECT source, count(*) FILTER (t_given) + count(*) FILTER (granted) AS external_calls_used, count(*) FILTER (t_given) AS translations_attempted, count(*) FILTER (granted) AS reviews_attempted,
    {CAP} AS external_call_limit, count(*) FILTER (translation_state = 'fallback_original') AS translation_fallbacks, count(*) FILTER (review_state = 'local_only') AS local_only,
    count(*) FILTER (review_state = 'reviewed') AS reviewed, count(*) FILTER (review_state = 'disagreement') AS disagreement, count(*) FILTER (review_state = 'fallback_local') AS fallback,
    {CAP} - count(*) FILTER (t_given) - count(*) FILTER (granted) AS remaining FROM ml_rows GROUP BY 1"""))
def call_breakdown(t: Tables) -> DataFrame:
    """Calls used per kind against the shared cap, with the batch summary."""
    found = batches.multilingual_summary(multilingual(t), CAP, BATCH)
    return found.withColumn("remaining", F.greatest(F.lit(0), F.col("external_call_limit") - F.col("external_calls_used")))


o.define("di0", """SELECT m.*, b.n <= 4 AS is_short, b.n <= 4 OR coalesce(language_status = 'detected' AND detected_language IN ('en', 'pt', 'it'), false) AS direct FROM ml_in m JOIN blank_split b USING (doc_id)""")
o.define("di1", "SELECT *, direct OR (NOT direct AND reasons <> '') AS ask FROM di0")
o.define("di2", f"SELECT *, CASE WHEN ask THEN row_number() OVER (PARTITION BY source, ask ORDER BY doc_id) <= {CAP} ELSE false END AS granted FROM di1")
o.define("di3", """SELECT d.*, x.success AS dok, x.verdict AS dverdict, x.error_code AS dcode, x.present AS dpresent, x.finish_reason AS dfinish, x.latency_ms AS dlatency, h.success AS hok, h.verdict AS hverdict
    FROM di2 d JOIN rd x ON x.order_key = d.doc_id JOIN rv h ON h.order_key = d.doc_id""")
o.define("direct_rows", """SELECT doc_id, source, CASE WHEN direct AND granted AND dok THEN dverdict WHEN NOT direct AND granted AND hok THEN hverdict ELSE sentiment END AS sentiment, confidence, sentiment AS local_sentiment,
    CASE WHEN NOT is_short THEN detected_language END AS detected_language, CASE WHEN is_short THEN 'short_text_uncertain' ELSE language_status END AS language_state, direct AS direct_review_requested,
    CASE WHEN NOT direct THEN 'local_only' WHEN granted AND dok THEN 'direct_multilingual_review' ELSE 'direct_review_failed' END AS direct_review_state,
    CASE WHEN direct AND granted AND dpresent THEN dfinish END AS direct_review_finish_reason, CASE WHEN direct AND granted AND dpresent THEN dlatency END AS direct_review_latency_ms,
    CASE WHEN direct AND NOT granted THEN 'external_budget_exceeded' WHEN direct AND NOT dok THEN dcode END AS direct_review_error_code, granted FROM di3""")
_DIRECT = ["doc_id", "source", "sentiment", "confidence", "local_sentiment", "detected_language", "language_state", "direct_review_requested", "direct_review_state",
           "direct_review_finish_reason", "direct_review_latency_ms", "direct_review_error_code"]


def direct(t: Tables) -> DataFrame:
    return batches.direct_batch(t.documents.select("doc_id", "source", "text"), t.derived("responses"), group_cols=BATCH, hybrid_enabled=True)


@query("direct_route", o.with_ctes("SELECT doc_id, is_short, direct, CASE WHEN is_short THEN 'short_text_uncertain' ELSE language_status END AS language_state FROM di0"))
def direct_route(t: Tables) -> DataFrame:
    """Short text skips the detector: detection runs on the other rows only."""
    rows = with_tokens(comments(t)).withColumn("is_short", F.col("n_tokens") <= C.SHORT_TEXT_TOKENS)
    long = scoring.detect_language(rows.filter(~F.col("is_short")))
    _, goes = routing.direct_flags(F.col("text"))
    routed = long.select("doc_id", "is_short", goes.alias("direct"), F.col("language_status").alias("language_state"))
    short = rows.filter("is_short").select("doc_id", "is_short", F.lit(True).alias("direct"), F.lit("short_text_uncertain").alias("language_state"))
    return routed.unionByName(short)


@query("direct_consolidate", o.with_ctes("SELECT direct_review_state, direct_review_error_code, language_state, count(*) AS n FROM direct_rows GROUP BY ALL"))
def direct_consolidate(t: Tables) -> DataFrame:
    return direct(t).groupBy("direct_review_state", "direct_review_error_code", "language_state").agg(F.count(F.lit(1)).alias("n"))


@query("direct_batch", o.with_ctes(f"SELECT {', '.join(_DIRECT)} FROM direct_rows"), scores="confidence")
def direct_batch(t: Tables) -> DataFrame:
    return direct(t).select(*_DIRECT)


@query("direct_state_shares", o.with_ctes("SELECT source, direct_review_state AS state, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS percentage FROM direct_rows GROUP BY 1, 2"))
def direct_state_shares(t: Tables) -> DataFrame:
    return metrics.state_shares(direct(t), "direct_review_state", BATCH)


@query("direct_summary", o.with_ctes(f"""SELECT source, count(*) FILTER (granted) AS external_calls_used, count(*) FILTER (granted) AS direct_reviews_attempted, {CAP} AS external_call_limit,
    count(*) FILTER (direct_review_state = 'direct_review_failed') AS direct_review_fallbacks FROM direct_rows GROUP BY 1"""))
def direct_summary(t: Tables) -> DataFrame:
    return batches.direct_summary(direct(t), CAP, BATCH)


# --- contract invariants ---------------------------------------------------------------------

def translation_violations() -> F.Column:
    """Broken rules of a translation result row, in rule order."""
    success, text, code = F.col("success"), F.col("translated_text"), F.col("error_code")
    blank = F.coalesce(tx.strip(text) == "", F.lit(True))
    return F.array_compact(F.array(
        F.when(F.col("source_language") == F.col("target_language"), "same_language"),
        F.when(F.col("latency_ms") < 0, "negative_latency"),
        F.when(success & blank, "success_without_text"),
        F.when(success & code.isNotNull(), "success_with_error"),
        F.when(~success & text.isNotNull(), "failure_with_text"),
        F.when(~success & code.isNull(), "failure_without_error"),
        F.when(F.least(F.col("prompt_tokens"), F.col("completion_tokens")) < 0, "negative_usage")))


def detection_violations() -> F.Column:
    """Broken rules of a language detection row, in rule order."""
    status, code = F.coalesce(F.col("status"), F.lit("")), F.col("error_code")
    success, supported = (F.coalesce(F.col(c), F.lit(False)) for c in ("success", "supported"))
    names = F.create_map(*[F.lit(x) for pair in C.SUPPORTED_LANGUAGES.items() for x in pair])
    expected = F.try_element_at(names, F.coalesce(F.col("detected_language"), F.lit("")))
    return F.array_compact(F.array(
        F.when(~status.isin(*C.LANGUAGE_STATUSES), "unsupported_status"),
        F.when(~F.col("confidence").between(0, 1), "confidence_out_of_range"),
        F.when(success != status.isin("detected", "unsupported"), "success_against_status"),
        F.when((status == "detected") & (~supported | ~expected.eqNullSafe(F.col("language_name"))), "detected_without_supported_language"),
        F.when((status != "detected") & supported, "supported_without_detection"),
        F.when(success & code.isNotNull(), "success_with_error"),
        F.when(~success & (F.coalesce(code, F.lit("")) == ""), "failure_without_error")))


def preparation_violations() -> F.Column:
    """Broken rules of a preparation row (language and translation before inference), in rule order."""
    state, text, analysed = F.coalesce(F.col("translation_state"), F.lit("")), F.col("translated_text"), F.col("analysis_text")
    done, requested = state == "translated", F.coalesce(F.col("translation_requested"), F.lit(False))
    return F.array_compact(F.array(
        F.when(~state.isin(*C.TRANSLATION_STATES), "unsupported_state"),
        F.when(F.coalesce(analysed, F.lit("")) == "", "empty_analysis_text"),
        F.when(done & (~requested | (F.coalesce(text, F.lit("")) == "")), "translated_without_request_or_text"),
        F.when(done & ~analysed.eqNullSafe(text), "translation_not_analysed"),
        F.when(~done & text.isNotNull(), "text_without_translated_state"),
        F.when(state.isin("fallback_original", "unsupported_language", "detection_error") & ~analysed.eqNullSafe(F.col("original_text")), "fallback_changed_text")))


_INVARIANT_ROWS = """SELECT order_key, CASE WHEN order_key % 4 = 0 THEN 'es' ELSE 'en' END AS source_language, 'es' AS target_language,
    CASE WHEN order_key % 5 = 0 THEN NULL WHEN order_key % 7 = 0 THEN ' ' ELSE 'texto' END AS translated_text, transport_error IS NULL AS success,
    CASE WHEN order_key % 6 = 0 THEN 'invalid_json' ELSE transport_error END AS error_code, CASE WHEN order_key % 59 = 0 THEN -1.0 ELSE latency_ms END AS latency_ms,
    CASE WHEN order_key % 61 = 0 THEN -3 ELSE prompt_tokens END AS prompt_tokens, completion_tokens FROM {responses}"""


@query("result_invariants", o.with_ctes("WITH r AS (" + _INVARIANT_ROWS.replace("{responses}", "responses") + """) SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([
    CASE WHEN source_language = target_language THEN 'same_language' END, CASE WHEN latency_ms < 0 THEN 'negative_latency' END, CASE WHEN success AND coalesce(trim(translated_text), '') = '' THEN 'success_without_text' END,
    CASE WHEN success AND error_code IS NOT NULL THEN 'success_with_error' END, CASE WHEN NOT success AND translated_text IS NOT NULL THEN 'failure_with_text' END,
    CASE WHEN NOT success AND error_code IS NULL THEN 'failure_without_error' END, CASE WHEN least(prompt_tokens, completion_tokens) < 0 THEN 'negative_usage' END], lambda x: x IS NOT NULL)) AS rule FROM r) GROUP BY 1""").replace(")\nWITH r AS (", "),\nr AS ("))
def result_invariants(t: Tables) -> DataFrame:
    rows = t.spark.sql(_INVARIANT_ROWS, responses=t.derived("responses"))
    return rows.select(F.explode(translation_violations()).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_DETECTION_ROWS = """SELECT CASE order_key % 5 WHEN 0 THEN 'detected' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'unknown' WHEN 3 THEN 'error' ELSE 'other' END AS status, order_key % 3 <> 0 AS success, order_key % 2 = 0 AS supported,
    CASE WHEN order_key % 4 = 0 THEN 'es' WHEN order_key % 4 = 1 THEN 'de' ELSE 'en' END AS detected_language, CASE WHEN order_key % 7 < 4 THEN 'Español' ELSE 'Inglés' END AS language_name,
    CASE WHEN order_key % 11 = 0 THEN 1.5 WHEN order_key % 11 > 3 THEN 0.5 END AS confidence, CASE WHEN order_key % 13 = 0 THEN '' WHEN order_key % 13 < 5 THEN 'timeout' END AS error_code FROM {responses}"""
_PREPARATION_ROWS = """SELECT CASE order_key % 6 WHEN 0 THEN 'translated' WHEN 1 THEN 'not_needed' WHEN 2 THEN 'fallback_original' WHEN 3 THEN 'unsupported_language' WHEN 4 THEN 'detection_error' ELSE 'other' END AS translation_state,
    order_key % 5 <> 0 AS translation_requested, 'original' AS original_text, CASE WHEN order_key % 7 = 0 THEN '' WHEN order_key % 7 < 4 THEN 'texto' END AS translated_text,
    CASE WHEN order_key % 11 = 0 THEN '' WHEN order_key % 11 < 6 THEN 'texto' ELSE 'original' END AS analysis_text FROM {responses}"""
o.define("detection_results", _DETECTION_ROWS.replace("{responses}", "responses"))
o.define("preparation_results", _PREPARATION_ROWS.replace("{responses}", "responses"))


@query("preparation_invariants", o.with_ctes("""SELECT result, rule, count(*) AS n FROM (SELECT 'detection' AS result, unnest([
    CASE WHEN status NOT IN ('detected', 'unsupported', 'unknown', 'error') THEN 'unsupported_status' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END,
    CASE WHEN success <> (status IN ('detected', 'unsupported')) THEN 'success_against_status' END,
    CASE WHEN status = 'detected' AND (NOT supported OR CASE detected_language WHEN 'es' THEN 'Español' WHEN 'en' THEN 'Inglés' END IS DISTINCT FROM language_name) THEN 'detected_without_supported_language' END,
    CASE WHEN status <> 'detected' AND supported THEN 'supported_without_detection' END, CASE WHEN success AND error_code IS NOT NULL THEN 'success_with_error' END,
    CASE WHEN NOT success AND coalesce(error_code, '') = '' THEN 'failure_without_error' END]) AS rule FROM detection_results
    UNION ALL SELECT 'preparation', unnest([CASE WHEN translation_state = 'other' THEN 'unsupported_state' END, CASE WHEN analysis_text = '' THEN 'empty_analysis_text' END,
    CASE WHEN translation_state = 'translated' AND (NOT translation_requested OR coalesce(translated_text, '') = '') THEN 'translated_without_request_or_text' END,
    CASE WHEN translation_state = 'translated' AND analysis_text IS DISTINCT FROM translated_text THEN 'translation_not_analysed' END,
    CASE WHEN translation_state <> 'translated' AND translated_text IS NOT NULL THEN 'text_without_translated_state' END,
    CASE WHEN translation_state IN ('fallback_original', 'unsupported_language', 'detection_error') AND analysis_text <> original_text THEN 'fallback_changed_text' END]) FROM preparation_results)
    WHERE rule IS NOT NULL GROUP BY ALL"""))
def preparation_invariants(t: Tables) -> DataFrame:
    """Broken rules of detection and preparation results; :func:`result_invariants` has those of translations."""
    found = [
        t.spark.sql(sql, responses=t.derived("responses")).select(F.lit(name).alias("result"), F.explode(rules).alias("rule"))
        for name, sql, rules in (("detection", _DETECTION_ROWS, detection_violations()), ("preparation", _PREPARATION_ROWS, preparation_violations()))]
    return found[0].unionByName(found[1]).groupBy("result", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("batch_set_aside", o.with_ctes("""SELECT j.job, d.doc_id, d.source, CASE WHEN length(p.t) < 2 THEN 'too_short' WHEN length(p.t) > 5000 THEN 'too_long' END AS reason,
    CASE WHEN length(p.t) BETWEEN 2 AND 5000 THEN s.sentiment END AS sentiment FROM documents d JOIN stripped p USING (doc_id) LEFT JOIN scored s USING (doc_id),
    (VALUES ('hybrid'), ('multilingual'), ('direct')) j(job)"""))
def batch_set_aside(t: Tables) -> DataFrame:
    """Each batch job, without external services, on comments of allowed length, beside the comments that it sets aside."""
    rows, answers = t.documents.select("doc_id", "source", "text"), t.derived("responses")
    jobs = {
        "hybrid": batches.hybrid_batch(rows, answers, group_cols=BATCH, provider_available=False, refuse_long=True),
        "multilingual": batches.multilingual_batch(
            rows, answers, group_cols=BATCH, translator_available=False, reviewer_available=False, refuse_long=True),
        "direct": batches.direct_batch(rows, answers, group_cols=BATCH, provider_available=False, refuse_long=True)}
    aside = cut(scoring.set_aside(rows, ["doc_id", "source"]))
    parts = [part for name, results in jobs.items() for part in (
        results.select(F.lit(name).alias("job"), "doc_id", "source", F.lit(None).cast("string").alias("reason"), "sentiment"),
        aside.select(F.lit(name).alias("job"), "doc_id", "source", "reason", F.lit(None).cast("string").alias("sentiment")))]
    return reduce(DataFrame.unionByName, parts)
