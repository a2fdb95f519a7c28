"""Whole-batch jobs: hybrid, multilingual and direct review of a comment table.

Each stores its scored rows once (``durable.cut``): the budget needs one look at
all requests and the verdicts a second one, and scoring is the costly step. The
caller decides which columns ride along; leave the text out unless it is needed.
With ``refuse_long`` a text above the length limit is not judged and takes nothing
from the budget; ``scoring.set_aside`` lists it with the reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions import payloads
from vozlake.functions import text as tx
from vozlake.operators import ranking, routing, scoring
from vozlake.operators.routing import HYBRID_ROUTER, Router
from vozlake.operators.scoring import LanguageProfiles, LinearModel


def hybrid_batch(comments: DataFrame, responses: DataFrame, key: str = "doc_id", group_cols: Sequence[str] = (),
                 cap: int = C.MAX_REVIEWS_PER_BATCH, router: Router = HYBRID_ROUTER, model: LinearModel | None = None,
                 provider_available: bool = True, keep: Sequence[str] = (), refuse_long: bool = False) -> DataFrame:
    """Score, route, grant, attach, consolidate."""
    scored = scoring.score(scoring.prepare(comments, refuse_long=refuse_long), model)
    kept = [key, *[c for c in (*group_cols, *keep) if c != key]]
    stored = cut(routing.route(scored.select(*dict.fromkeys(kept), *scoring.SCORE_COLUMNS), router))
    if provider_available:
        granted = routing.grant(stored, F.col("should_review"), key, cap, group_cols)
        answered = routing.attach_granted(granted, responses, "sentiment_review", key, "granted")
    else:
        answered = routing.without_responses(stored.withColumn("granted", F.lit(False)), responses)
    return routing.consolidate(answered, provider_available=provider_available)


def _empty_translation(df: DataFrame, responses: DataFrame) -> DataFrame:
    return routing.without_responses(df, responses, "t_").withColumn(
        "_translation", F.lit(None).cast("struct<success:boolean,translated_text:string,error_code:string>"))


def multilingual_batch(comments: DataFrame, responses: DataFrame, key: str = "doc_id", group_cols: Sequence[str] = (),
                       cap: int = C.MAX_REVIEWS_PER_BATCH, enabled: bool = True, detector_available: bool = True,
                       translator_available: bool = True, reviewer_available: bool = True, hybrid_enabled: bool = True, router: Router = HYBRID_ROUTER,
                       model: LinearModel | None = None, profiles: LanguageProfiles | None = None,
                       keep: Sequence[str] = (), refuse_long: bool = False) -> DataFrame:
    """Detect, translate, score, review under one shared budget.

    Only the first ``cap`` rows with demand in a batch can receive a call, and
    who has demand is known from the original text alone. Translations are
    attached and scored for those rows only. Where the pipeline is off or has no
    detector, no language is reported and none counts as supported.
    """
    groups = list(group_cols)
    model = model or LinearModel.starter()
    router = router if hybrid_enabled else Router(confidence_threshold=None)
    kept = list(dict.fromkeys([key, *groups, *keep]))
    languages = ["detected_language", "language_status"]
    prepared = scoring.prepare(comments, refuse_long=refuse_long)
    seen = scoring.detect_language(prepared, profiles) if enabled and detector_available else \
        prepared.withColumns({c: F.lit(None).cast("string") for c in languages})
    scored = scoring.score(seen, model)
    base = routing.route(scored.select(*kept, *languages, *scoring.SCORE_COLUMNS), router)
    can_translate = routing.wants_translation(enabled) & F.lit(translator_available)
    can_review = F.col("should_review") & F.lit(reviewer_available)
    base = cut(base.withColumn("_t", F.coalesce(can_translate, F.lit(False))).withColumn("_demand", F.col("_t") | can_review))

    marked = routing.grant(base, F.col("_demand"), key, cap, groups, name="_candidate")
    early, late = marked.filter("_candidate"), marked.filter(~F.col("_candidate"))

    # rows that may call: what text would they be judged on?
    called = routing.attach_granted(early, responses, "translation", key, "_t", "t_")
    called = called.withColumn("_translation", payloads.translation(
        F.col("t_present"), F.col("t_transport_error"), F.col("t_raw"), F.col("detected_language")))
    usable = F.coalesce(F.col("_t") & F.col("_translation.success"), F.lit(False))
    both = called.withColumn("_alt", F.when(usable, model.score(F.col("_translation.translated_text")))).withColumn(
        "_alt_reasons", router.reasons(None, "_alt.sentiment", "_alt.confidence", "_alt.prediction_margin"))
    wish = F.when(usable, F.size("_alt_reasons") > 0).otherwise(F.col("should_review")) & F.lit(reviewer_available)
    judged = routing.shared_grants(both, F.col("_t"), wish, key, cap, groups)
    # a refused translation leaves the row on its original text
    used = usable & F.col("translation_granted")
    judged = judged.withColumns({
        **{n: F.when(used, F.col(f"_alt.{n}")).otherwise(F.col(n)) for n in scoring.SCORE_COLUMNS},
        "reasons": F.when(used, F.col("_alt_reasons")).otherwise(F.col("reasons")),
        "should_review": F.when(used, F.size("_alt_reasons") > 0).otherwise(F.col("should_review")),
    }).drop("_alt", "_alt_reasons")
    rest = _empty_translation(late, responses) \
        .withColumn("translation_granted", F.lit(False)).withColumn("review_granted", F.lit(False))
    together = judged.unionByName(rest)
    given = F.col("translation_granted")
    state, code = routing.preparation_state(
        enabled, detector_available, translator_available, given, F.coalesce(F.col("_translation.success"), F.lit(False)), F.col("_translation.error_code"))
    seen = given & F.col("t_present")
    ready = together.withColumns({
        "language_supported": F.coalesce(F.col("language_status") == "detected", F.lit(False)),
        "translation_requested": F.coalesce(routing.wants_translation(enabled), F.lit(False)),
        "translation_state": state, "translation_error_code": code,
        "translation_provider": F.when(seen, F.col("t_provider")), "translation_model": F.when(seen, F.col("t_model")),
        "translation_latency_ms": F.when(seen, F.col("t_latency_ms")),
    })
    trace = [*kept, "detected_language", "language_supported", "translation_requested", "translation_state", "translation_provider",
             "translation_model", "translation_latency_ms", "translation_error_code", "translation_granted", "review_granted",
             *scoring.SCORE_COLUMNS, "reasons", "should_review"]
    answered = routing.attach_granted(ready.select(*trace), responses, "sentiment_review", key, "review_granted")
    return routing.consolidate(answered, "review_granted", reviewer_available)


def multilingual_summary(results: DataFrame, cap: int = C.MAX_REVIEWS_PER_BATCH, group_cols: Sequence[str] = ()) -> DataFrame:
    state = F.col("review_state")
    translations, reviews = F.count_if("translation_granted"), F.count_if("call_made")
    return results.groupBy(*group_cols).agg(
        (translations + reviews).alias("external_calls_used"), translations.alias("translations_attempted"),
        reviews.alias("reviews_attempted"), F.any_value(F.lit(cap)).alias("external_call_limit"),
        F.count_if(F.col("translation_state") == "fallback_original").alias("translation_fallbacks"),
        F.count_if(state == "local_only").alias("local_only"), F.count_if(state == "reviewed").alias("reviewed"),
        F.count_if(state == "disagreement").alias("disagreement"), F.count_if(state == "fallback_local").alias("fallback"))


def direct_batch(comments: DataFrame, responses: DataFrame, key: str = "doc_id", group_cols: Sequence[str] = (),
                 cap: int = C.MAX_REVIEWS_PER_BATCH, provider_available: bool = True, hybrid_enabled: bool = False,
                 hybrid_available: bool = True, router: Router = HYBRID_ROUTER, model: LinearModel | None = None,
                 profiles: LanguageProfiles | None = None, keep: Sequence[str] = (), refuse_long: bool = False) -> DataFrame:
    """One call per row at most: direct review of short or foreign text, else local or hybrid."""
    groups = list(group_cols)
    router = router if hybrid_enabled else Router(confidence_threshold=None)
    kept = list(dict.fromkeys([key, *groups, *keep]))
    scored = scoring.score(scoring.detect_language(scoring.prepare(comments, refuse_long=refuse_long), profiles), model)
    short, direct = routing.direct_flags(F.col("text"))
    base = routing.route(scored.withColumn("_short", short).withColumn("_direct", direct).select(
        *kept, "detected_language", "language_status", "_short", "_direct", *scoring.SCORE_COLUMNS), router)
    base = base.withColumn("should_review", F.col("should_review") & ~F.col("_direct")) \
        .withColumn("reasons", F.when(F.col("should_review"), F.col("reasons")).otherwise(F.array().cast("array<string>")))
    base = cut(base.withColumn("_ask", (F.col("_direct") & F.lit(provider_available)) | F.col("should_review")))
    granted = routing.grant(base, F.col("_ask"), key, cap, groups)
    granted = granted.withColumn("_call_direct", F.col("granted") & F.col("_direct")) \
        .withColumn("_call_hybrid", F.col("granted") & F.col("should_review"))
    answered = routing.attach_granted(granted, responses, "direct_review", key, "_call_direct", "d_")
    answered = routing.attach_granted(answered, responses, "sentiment_review", key, "_call_hybrid", "r_")
    checked = answered.withColumn("_d", payloads.direct(
        F.col("d_present"), F.col("d_transport_error"), F.col("d_raw"), F.col("d_finish_reason"))) \
        .withColumn("_h", payloads.review(F.col("r_present"), F.col("r_transport_error"), F.col("r_raw")))
    ok = F.col("_call_direct") & F.col("_d.success")
    hybrid_ok = F.col("_call_hybrid") & F.col("_h.success") & F.lit(hybrid_available)
    seen = F.col("_call_direct") & F.col("d_present")
    is_direct = F.col("_direct")
    refused = F.lit("external_budget_exceeded") if provider_available else F.lit("unavailable")
    return checked.select(
        *kept,
        F.when(ok, F.col("_d.sentiment")).when(hybrid_ok, F.col("_h.sentiment")).otherwise(F.col("sentiment")).alias("sentiment"),
        "confidence", "probability_negativo", "probability_neutro", "probability_positivo",
        F.col("sentiment").alias("local_sentiment"), F.col("confidence").alias("local_confidence"),
        F.when(~F.col("_short"), F.col("detected_language")).alias("detected_language"),
        F.when(F.col("_short"), "short_text_uncertain").otherwise(F.col("language_status")).alias("language_state"),
        is_direct.alias("direct_review_requested"),
        F.when(~is_direct, "local_only").when(ok, "direct_multilingual_review").otherwise("direct_review_failed").alias("direct_review_state"),
        F.when(seen, F.col("d_provider")).alias("direct_review_provider"), F.when(seen, F.col("d_model")).alias("direct_review_model"),
        F.when(seen, F.col("d_latency_ms")).alias("direct_review_latency_ms"),
        F.when(seen, F.col("d_finish_reason")).alias("direct_review_finish_reason"),
        F.when(is_direct & ~F.col("_call_direct"), refused).when(is_direct & ~ok, F.col("_d.error_code")).alias("direct_review_error_code"),
        F.col("granted").alias("call_made"))


def direct_summary(results: DataFrame, cap: int = C.MAX_REVIEWS_PER_BATCH, group_cols: Sequence[str] = ()) -> DataFrame:
    made = F.count_if("call_made")
    return results.groupBy(*group_cols).agg(
        made.alias("external_calls_used"), made.alias("direct_reviews_attempted"), F.any_value(F.lit(cap)).alias("external_call_limit"),
        F.count_if(F.col("direct_review_state") == "direct_review_failed").alias("direct_review_fallbacks"))
