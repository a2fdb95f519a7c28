"""Queries over batch metrics and scorer evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.functions import text as tx
from vozlake.operators import evaluation as ev
from vozlake.operators import joins, metrics, scoring
from vozlake.plans import oracle as o
from vozlake.plans.model_queries import scored
from vozlake.plans.registry import Tables, query
from vozlake.plans.text_queries import comments, with_tokens

# --- batch metrics ----------------------------------------------------------------

o.define("bm0", """SELECT source, count(*) AS total, count(*) FILTER (sentiment = 'Negativo') AS neg_n, count(*) FILTER (sentiment = 'Neutro') AS neu_n,
    count(*) FILTER (sentiment = 'Positivo') AS pos_n, avg(confidence) AS mean_c, quantile_cont(confidence, 0.75) AS p75 FROM scored GROUP BY 1""")
o.define("bm_metrics", """SELECT source, total, neg_n AS negative_count, neu_n AS neutral_count, pos_n AS positive_count,
    round(neg_n * 100.0::DOUBLE / total, 6) AS negative_percentage, round(neu_n * 100.0::DOUBLE / total, 6) AS neutral_percentage,
    round(pos_n * 100.0::DOUBLE / total, 6) AS positive_percentage,
    CASE WHEN neg_n > 0 THEN round(pos_n::DOUBLE / neg_n, 6) WHEN pos_n > 0 THEN 'inf'::DOUBLE ELSE 0.0::DOUBLE END AS positive_negative_ratio,
    round(mean_c, 6) AS mean_confidence, round(p75, 8) AS critical_confidence_threshold,
    (SELECT count(*) FROM scored s WHERE s.source = b.source AND s.sentiment = 'Negativo' AND s.confidence >= b.p75) AS critical_negative_count FROM bm0 b""")
_BATCH = ["source"]


def batch_metrics(t: Tables) -> DataFrame:
    return metrics.sentiment_metrics(scored(t), _BATCH)


@query("sentiment_metrics", o.with_ctes("SELECT * FROM bm_metrics"))
def sentiment_metrics(t: Tables) -> DataFrame:
    return batch_metrics(t)


@query("sentiment_distribution", o.with_ctes("""SELECT source, 0 AS position, 'Negativo' AS sentiment, negative_count AS count, negative_percentage AS percentage FROM bm_metrics
    UNION ALL SELECT source, 1, 'Neutro', neutral_count, neutral_percentage FROM bm_metrics UNION ALL SELECT source, 2, 'Positivo', positive_count, positive_percentage FROM bm_metrics"""))
def sentiment_distribution(t: Tables) -> DataFrame:
    return metrics.sentiment_distribution(batch_metrics(t), _BATCH)


@query("confidence_by_class", o.with_ctes("SELECT source, sentiment, round(avg(confidence), 6) AS mean_confidence FROM scored GROUP BY 1, 2"))
def confidence_by_class(t: Tables) -> DataFrame:
    return metrics.confidence_by_class(scored(t), _BATCH)


# --- evaluation against references ---------------------------------------------------

def referenced(t: Tables) -> DataFrame:
    """Comments that have a reference; the others need no score here."""
    return joins.only_keys(comments(t), t.derived("truth"), "doc_id")


def cases(t: Tables) -> DataFrame:
    return ev.details(scoring.score(referenced(t)).drop("text"), t.derived("truth"))


def counts(t: Tables, groups=()) -> DataFrame:
    return ev.confusion_counts(cases(t), groups)


@query("join_references", o.with_ctes("SELECT doc_id, sentiment, confidence, expected FROM evaluated"), scores="confidence")
def join_references(t: Tables) -> DataFrame:
    """Predictions with references; a repeated key on either side is an error."""
    return joins.one_to_one(scoring.score(referenced(t)).select("doc_id", "sentiment", "confidence"), t.derived("truth"), "doc_id")


@query("accuracy", o.with_ctes("SELECT count(*) AS cases, round(avg(is_correct::INT), 6) AS accuracy FROM evaluated"))
def accuracy(t: Tables) -> DataFrame:
    return cases(t).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"))


@query("per_class_prf", o.with_ctes("""SELECT name AS class, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1_, 6) AS f1, support::BIGINT AS support,
    round(tp / nullif(support, 0), 6) AS accuracy FROM prf"""))
def per_class_prf(t: Tables) -> DataFrame:
    return ev.class_metrics(counts(t))


@query("macro_weighted_f1", o.with_ctes("""SELECT sum(support)::BIGINT AS cases, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1_), 6) AS macro_f1,
    round(sum(f1_ * support) / sum(support), 6) AS weighted_f1 FROM prf"""))
def macro_weighted_f1(t: Tables) -> DataFrame:
    return ev.summary(counts(t))


@query("confusion_matrix", o.with_ctes("SELECT expected, predicted, n FROM confusion"))
def confusion_matrix(t: Tables) -> DataFrame:
    return ev.confusion_matrix(counts(t))


@query("evaluation_details", o.with_ctes("""SELECT doc_id, expected, sentiment, confidence, second_best_class, second_best_probability, prediction_margin, is_correct,
    below_80_percent, high_confidence_error FROM evaluated"""), scores="confidence second_best_probability prediction_margin")
def evaluation_details(t: Tables) -> DataFrame:
    return cases(t).select("doc_id", "expected", "sentiment", "confidence", "second_best_class", "second_best_probability",
                           "prediction_margin", "is_correct", "below_80_percent", "high_confidence_error")


@query("confidence_diagnostics", o.with_ctes("""SELECT count(*) AS cases, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (below_80_percent) AS below_80_count,
    round(count(*) FILTER (below_80_percent) * 100.0::DOUBLE / count(*), 6) AS below_80_percentage, count(*) FILTER (high_confidence_error) AS high_confidence_errors FROM evaluated"""))
def confidence_diagnostics(t: Tables) -> DataFrame:
    return ev.confidence_diagnostics(cases(t))


@query("margin_distribution", o.with_ctes("""SELECT round(min(prediction_margin), 6) AS margin_min, round(quantile_cont(prediction_margin, 0.25), 8) AS p25,
    round(quantile_cont(prediction_margin, 0.5), 8) AS median, round(quantile_cont(prediction_margin, 0.75), 8) AS p75, round(max(prediction_margin), 6) AS margin_max,
    round(avg(prediction_margin), 6) AS margin_mean FROM evaluated"""))
def margin_distribution(t: Tables) -> DataFrame:
    return ev.margin_distribution(cases(t))


@query("error_flows", o.with_ctes("SELECT expected, predicted, n FROM confusion WHERE expected <> predicted AND n > 0"))
def error_flows(t: Tables) -> DataFrame:
    return ev.error_flows(counts(t))


@query("error_cases", o.with_ctes("SELECT doc_id, expected, sentiment AS obtained, confidence, high_confidence_error FROM evaluated WHERE expected <> sentiment"), scores="confidence")
def error_cases(t: Tables) -> DataFrame:
    return cases(t).filter(~F.col("is_correct")).select("doc_id", "expected", F.col("sentiment").alias("obtained"), "confidence", "high_confidence_error")


@query("confidence_correct_vs_error", o.with_ctes("""SELECT is_correct, count(*) AS n, round(avg(confidence), 6) AS mean_confidence,
    round(quantile_cont(confidence, 0.5), 8) AS median_confidence FROM evaluated GROUP BY 1"""))
def confidence_correct_vs_error(t: Tables) -> DataFrame:
    return ev.confidence_by_outcome(cases(t))


o.define("flagged", f"""SELECT v.*, {o.negation('v.text')} AS is_negation, {o.contrast('v.text')} AS is_contrast, b.n <= 4 AS is_short FROM evaluated v JOIN blank_split b USING (doc_id)""")
_SUBSET = " UNION ALL ".join(f"""SELECT '{name}' AS subset, count(*) AS cases, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS errors,
    round(avg(is_correct::INT), 6) AS accuracy, count(*) FILTER (sentiment = 'Negativo') AS predicted_negative, count(*) FILTER (sentiment = 'Neutro') AS predicted_neutral,
    count(*) FILTER (sentiment = 'Positivo') AS predicted_positive FROM flagged WHERE {test}""" for name, test in (
    ("factual_neutral", "expected = 'Neutro'"), ("negation", "is_negation"), ("short", "is_short"), ("contrast", "is_contrast")))


def flagged_cases(t: Tables) -> DataFrame:
    """Text flags are taken beside the score, so the join carries no text."""
    text = F.col("text")
    flagged = scoring.score(referenced(t)).select(
        "doc_id", "source", "lang", *scoring.SCORE_COLUMNS, tx.negation_flag(text).alias("is_negation"), tx.contrast_flag(text).alias("is_contrast"),
        (tx.token_count(text) <= C.SHORT_TEXT_TOKENS).alias("is_short"))
    return ev.details(flagged, t.derived("truth"))


@query("subset_accuracy", o.with_ctes(_SUBSET))
def subset_accuracy(t: Tables) -> DataFrame:
    return ev.subset_accuracy(flagged_cases(t), {
        "factual_neutral": F.col("expected") == C.NEUTRAL, "negation": F.col("is_negation"),
        "short": F.col("is_short"), "contrast": F.col("is_contrast")})


@query("class_label_distribution", o.with_ctes("SELECT name AS class, support::BIGINT AS expected_count, chosen::BIGINT AS predicted_count FROM prf0"))
def class_label_distribution(t: Tables) -> DataFrame:
    return ev.label_distribution(counts(t))


@query("accuracy_by_dimension", o.with_ctes(" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c}::VARCHAR AS value, count(*) AS cases, count(*) FILTER (is_correct) AS correct, round(avg(is_correct::INT), 6) AS accuracy FROM flagged GROUP BY 2"
    for d, c in (("language", "lang"), ("class", "expected"), ("source", "source"), ("short", "is_short")))))
def accuracy_by_dimension(t: Tables) -> DataFrame:
    return ev.accuracy_by_dimensions(flagged_cases(t), {
        "language": F.col("lang"), "class": F.col("expected"), "source": F.col("source"), "short": F.col("is_short")})


o.define("sub_cls", """SELECT lang, c.name, count(*) FILTER (expected = c.name AND sentiment = c.name) AS tp, count(*) FILTER (expected = c.name) AS sup,
    count(*) FILTER (sentiment = c.name) AS cho FROM evaluated, classes c GROUP BY 1, 2""")


@query("subgroup_metrics", o.with_ctes("""SELECT lang, sum(sup)::BIGINT AS cases, round(sum(tp) / sum(sup), 6) AS accuracy,
    round(sum(coalesce(2.0::DOUBLE * tp / nullif(sup + cho, 0), 0)) / 3, 6) AS macro_f1,
    round(sum(coalesce(2.0::DOUBLE * tp / nullif(sup + cho, 0), 0) * sup) / sum(sup), 6) AS weighted_f1 FROM sub_cls GROUP BY 1"""))
def subgroup_metrics(t: Tables) -> DataFrame:
    return ev.summary(counts(t, ["lang"]), ["lang"])


@query("subgroup_class_metrics", o.with_ctes("""SELECT lang, name AS class, round(coalesce(tp::DOUBLE / nullif(cho, 0), 0), 6) AS precision,
    round(coalesce(tp::DOUBLE / nullif(sup, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(sup + cho, 0), 0), 6) AS f1, sup AS support,
    round(tp::DOUBLE / nullif(sup, 0), 6) AS accuracy FROM sub_cls"""))
def subgroup_class_metrics(t: Tables) -> DataFrame:
    return ev.class_metrics(counts(t, ["lang"]), ["lang"])


_STRATEGIES = [("confidence_lt_0.80", -1.0)] + [(f"confidence_lt_0.80_or_margin_lt_{m:.2f}", m) for m in C.MARGIN_SWEEP]


@query("router_sweep", o.with_ctes(f"""SELECT strategy, count(*) FILTER (sent) AS review_count, round(count(*) FILTER (sent) * 100.0::DOUBLE / count(*), 6) AS review_coverage_percentage,
    count(*) FILTER (sent AND NOT is_correct) AS local_errors_captured, count(*) FILTER (NOT sent AND NOT is_correct) AS local_errors_missed,
    count(*) FILTER (sent AND is_correct) AS local_correct_sent_to_review,
    round(coalesce(count(*) FILTER (sent AND NOT is_correct)::DOUBLE / nullif(count(*) FILTER (sent), 0), 0), 6) AS router_error_precision
    FROM (SELECT strategy, is_correct, confidence < 0.8 OR prediction_margin < m AS sent FROM evaluated,
      (VALUES {', '.join(f"('{s}', {m})" for s, m in _STRATEGIES)}) v(strategy, m)) GROUP BY 1"""))
def router_sweep(t: Tables) -> DataFrame:
    return ev.router_sweep(cases(t))


o.define("abst", f"""SELECT e.*, v.threshold::DOUBLE AS threshold, confidence >= v.threshold AS covered FROM evaluated e, (VALUES {', '.join(f'({x})' for x in C.ABSTENTION_SWEEP)}) v(threshold)""")
o.define("abst_cls", """SELECT threshold, c.name, count(*) FILTER (covered AND expected = c.name AND sentiment = c.name) AS tp, count(*) FILTER (covered AND expected = c.name) AS sup,
    count(*) FILTER (covered AND sentiment = c.name) AS cho, count(*) FILTER (expected = c.name) AS every, count(*) FILTER (expected = c.name AND NOT covered) AS outside FROM abst, classes c GROUP BY 1, 2""")


@query("abstention_sweep", o.with_ctes("""SELECT threshold, sum(sup)::BIGINT AS covered_cases, round(sum(sup) / sum(every), 6) AS coverage, round(sum(tp) / nullif(sum(sup), 0), 6) AS selective_accuracy,
    CASE WHEN sum(sup) > 0 THEN round(sum(coalesce(2.0::DOUBLE * tp / nullif(sup + cho, 0), 0)) / 3, 6) END AS selective_macro_f1,
    """ + ", ".join(f"round(sum(outside) FILTER (name = '{c}') / nullif(sum(every) FILTER (name = '{c}'), 0), 6) AS abstention_{s}" for c, s in C.CLASS_SLUGS.items())
    + ", (sum(sup) - sum(tp))::BIGINT AS errors_remaining FROM abst_cls GROUP BY 1"))
def abstention_sweep(t: Tables) -> DataFrame:
    return ev.abstention_sweep(cases(t))


@query("representative_errors", o.with_ctes("""SELECT doc_id, expected, sentiment, confidence FROM (SELECT *, row_number() OVER (PARTITION BY expected, sentiment ORDER BY confidence DESC, doc_id) AS r
    FROM evaluated WHERE NOT is_correct) WHERE r = 1"""), scores="confidence")
def representative_errors(t: Tables) -> DataFrame:
    return ev.representative_errors(cases(t))


# --- language detection against the stated language -----------------------------------

o.define("lang_cases", "SELECT doc_id, lang, detected_language, language_status, runner_up_score, language_score, coalesce(detected_language = lang, false) AS ok FROM lang_detected")


def language_cases(t: Tables) -> DataFrame:
    found = scoring.detect_language(comments(t)).drop("text")
    return found.withColumn("ok", F.coalesce(F.col("detected_language") == F.col("lang"), F.lit(False)))


@query("language_detection_eval", o.with_ctes("""SELECT lang, count(*) AS cases, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy,
    count(*) FILTER (language_status = 'unknown') AS unknown, count(*) FILTER (language_status = 'unsupported') AS unsupported, count(*) FILTER (NOT ok) AS errors FROM lang_cases GROUP BY 1"""))
def language_detection_eval(t: Tables) -> DataFrame:
    return language_cases(t).groupBy("lang").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("correct"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"),
        F.count_if(F.col("language_status") == "unknown").alias("unknown"), F.count_if(F.col("language_status") == "unsupported").alias("unsupported"),
        F.count_if(~F.col("ok")).alias("errors"))


@query("language_confusion", o.with_ctes("SELECT lang || '->' || coalesce(detected_language, 'none') AS flow, count(*) AS n FROM lang_cases GROUP BY 1"))
def language_confusion(t: Tables) -> DataFrame:
    flow = F.concat("lang", F.lit("->"), F.coalesce("detected_language", F.lit("none")))
    return language_cases(t).groupBy(flow.alias("flow")).agg(F.count(F.lit(1)).alias("n"))


@query("repeat_stability", o.with_ctes("""SELECT lang, count(*) AS cases, count(*) AS stable_cases, round(max(language_score), 6) AS top_score,
    round(max(language_score - runner_up_score), 6) AS top_gap FROM lang_cases GROUP BY 1"""))
def repeat_stability(t: Tables) -> DataFrame:
    """Detection repeated three times; a case is stable when all runs agree."""
    runs = comments(t).select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"))
    found = scoring.detect_language(runs)
    per_case = found.groupBy("doc_id", "lang").agg(
        (F.max(F.coalesce("detected_language", F.lit(""))) == F.min(F.coalesce("detected_language", F.lit("")))).alias("stable"),
        F.max("language_score").alias("score"), F.max("runner_up_score").alias("second"))
    return per_case.groupBy("lang").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("stable").alias("stable_cases"), F.round(F.max("score"), 6).alias("top_score"),
        F.round(F.max(F.col("score") - F.col("second")), 6).alias("top_gap"))


@query("short_text_policy", o.with_ctes("""SELECT d.lang, count(*) AS captured, count(*) FILTER (ok) AS detector_correct, round(avg(ok::INT), 6) AS detector_accuracy,
    count(*) FILTER (d.lang <> 'es') AS default_spanish_would_be_wrong FROM lang_cases d JOIN blank_split b USING (doc_id) WHERE b.n <= 4 GROUP BY 1"""))
def short_text_policy(t: Tables) -> DataFrame:
    short = with_tokens(comments(t)).filter(F.col("n_tokens") <= C.SHORT_TEXT_TOKENS)
    found = scoring.detect_language(short).withColumn("ok", F.coalesce(F.col("detected_language") == F.col("lang"), F.lit(False)))
    return found.groupBy("lang").agg(
        F.count(F.lit(1)).alias("captured"), F.count_if("ok").alias("detector_correct"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("detector_accuracy"),
        F.count_if(F.col("lang") != "es").alias("default_spanish_would_be_wrong"))
