"""Routing, call budgets, response attachment and consolidation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions import payloads
from vozlake.functions import text as tx
from vozlake.operators import ranking


@dataclass(frozen=True)
class Router:
    """When to ask for a second check. Class thresholds win over the global one."""

    confidence_threshold: float | None = C.GLOBAL_THRESHOLD
    margin_threshold: float | None = None
    class_thresholds: Mapping[str, float] | None = None

    def __post_init__(self) -> None:
        numbers = [self.confidence_threshold, self.margin_threshold, *(self.class_thresholds or {}).values()]
        if any(n is not None and not 0 <= n <= 1 for n in numbers):
            raise ValueError("thresholds must lie between 0 and 1")
        if self.class_thresholds is not None and set(self.class_thresholds) != set(C.CLASSES):
            raise ValueError("class thresholds must cover exactly the three classes")

    def reasons(self, signals: Column | None = None, sentiment: str = "sentiment",
                confidence: str = "confidence", margin: str = "prediction_margin") -> Column:
        """array<string> of review reasons, each once, in rule order."""
        label, score = F.col(sentiment), F.col(confidence)
        found: list[Column] = []
        if self.class_thresholds is not None:
            rule = None
            for c, limit in self.class_thresholds.items():
                test, text = (label == c) & (score < limit), F.lit(f"low_confidence:{c}<{limit:.2f}")
                rule = F.when(test, text) if rule is None else rule.when(test, text)
            found.append(rule)
        elif self.confidence_threshold is not None:
            found.append(F.when(score < self.confidence_threshold, F.lit("low_confidence")))
        if self.margin_threshold is not None:
            found.append(F.when(F.col(margin) < self.margin_threshold, F.lit("small_margin")))
        own = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        return F.array_distinct(F.concat(own, signals)) if signals is not None else own


HYBRID_ROUTER = Router(confidence_threshold=None, class_thresholds=C.CLASS_THRESHOLDS)


def unsupported_signals(signals: Column) -> Column:
    return F.array_except(signals, F.array(*[F.lit(s) for s in C.ROUTING_SIGNALS]))


def route(df: DataFrame, router: Router = HYBRID_ROUTER, signals: Column | None = None) -> DataFrame:
    """Append ``reasons`` and ``should_review``."""
    return df.withColumn("reasons", router.reasons(signals)).withColumn("should_review", F.size("reasons") > 0)


# --- budgets ---------------------------------------------------------------------

def last_granted(df: DataFrame, requested: Column, key: str, cap: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Key of the last request inside the budget, one row per batch.

    The first ``cap`` requests in key order get a call, so a batch's budget is
    just a key. Each input partition keeps its own first ``cap`` rows before the
    shuffle, however large the batch.
    """
    asked = df.filter(requested).select(*group_cols, key)
    if not group_cols:
        return asked.orderBy(key).limit(cap).agg(F.max(key).alias("last_key"))
    return ranking.first_per_group(asked, list(group_cols), [F.col(key).asc()], cap) \
        .groupBy(*group_cols).agg(F.max(key).alias("last_key"))


def grant(df: DataFrame, requested: Column, key: str, cap: int, group_cols: Sequence[str] = (), name: str = "granted") -> DataFrame:
    """Flag the requests that fit the budget."""
    last = last_granted(df, requested, key, cap, group_cols)
    if not group_cols:
        limit = last.scalar()
        return df.withColumn(name, requested & F.coalesce(F.col(key) <= limit, F.lit(False)))
    # stored, so that its real size decides the join and the table need not move
    return ranking.join_groups(df, cut(last, "last-granted"), list(group_cols), "left") \
        .withColumn(name, requested & F.coalesce(F.col(key) <= F.col("last_key"), F.lit(False))).drop("last_key")


def shared_grants(candidates: DataFrame, translate: Column, review: Column, key: str, cap: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """One budget over two kinds of call for at most ``cap`` rows per batch.

    ``candidates`` holds the first ``cap`` rows with any demand. Calls used before
    a row are the demand of the earlier ones, and once the cap is reached it
    stays reached, so a prefix sum decides both grants.
    """
    before = Window.partitionBy(*group_cols).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    asked_t, asked_r = translate.cast("int"), review.cast("int")
    used = F.coalesce(F.sum(asked_t + asked_r).over(before), F.lit(0))
    return candidates.withColumn("_used", used) \
        .withColumn("translation_granted", translate & (F.col("_used") < cap)) \
        .withColumn("review_granted", review & (F.col("_used") + asked_t < cap)).drop("_used")


# --- responses ---------------------------------------------------------------------

RESPONSE_FIELDS = ("raw", "finish_reason", "transport_error", "provider", "model", "latency_ms", "prompt_tokens", "completion_tokens")


def attach(df: DataFrame, responses: DataFrame, kind: str, key: str, prefix: str = "r_") -> DataFrame:
    """Left join the response of one kind; ``{prefix}present`` tells a found row."""
    table = responses.filter(F.col("kind") == kind).select(
        F.col("order_key").alias(key), *[F.col(f).alias(prefix + f) for f in RESPONSE_FIELDS], F.lit(True).alias(prefix + "present"))
    return df.join(table, key, "left").withColumn(prefix + "present", F.coalesce(F.col(prefix + "present"), F.lit(False)))


def without_responses(df: DataFrame, responses: DataFrame, prefix: str = "r_") -> DataFrame:
    """The columns of :func:`attach` for rows that made no call, without a join."""
    kinds = {f.name: f.dataType for f in responses.schema}
    return df.select("*", *[F.lit(None).cast(kinds[f]).alias(prefix + f) for f in RESPONSE_FIELDS], F.lit(False).alias(prefix + "present"))


def attach_granted(df: DataFrame, responses: DataFrame, kind: str, key: str, granted: str, prefix: str = "r_") -> DataFrame:
    """Only granted rows take part in the join; the others pass by unshuffled."""
    called = attach(df.filter(F.col(granted)), responses, kind, key, prefix)
    return called.unionByName(without_responses(df.filter(~F.col(granted)), responses, prefix))


# --- consolidation -------------------------------------------------------------------

def consolidate(df: DataFrame, granted: str = "granted", provider_available: bool = True, prefix: str = "r_") -> DataFrame:
    """Local score plus checked response to the final verdict and trace columns."""
    asked, called = F.col("should_review"), F.col(granted)
    checked = df.withColumn("_review", payloads.review(F.col(prefix + "present"), F.col(prefix + "transport_error"), F.col(prefix + "raw")))
    success = F.col("_review.success")
    answered = asked & called & success if provider_available else F.lit(False)
    state = (
        F.when(~asked, "local_only").when(~answered, "fallback_local")
        .when(F.col("_review.sentiment") == F.col("sentiment"), "reviewed").otherwise("disagreement")
    )
    if provider_available:
        code = F.when(~asked, None).when(~called, "review_budget_exceeded").when(~success, F.col("_review.error_code"))
    else:
        code = F.when(asked, F.lit("unavailable"))
    seen = asked & called & F.col(prefix + "present") if provider_available else F.lit(False)
    trace = checked.select(
        *[c for c in df.columns if c not in ("sentiment", "reasons", "should_review") and not c.startswith(prefix) and c != granted],
        F.when(answered, F.col("_review.sentiment")).otherwise(F.col("sentiment")).alias("sentiment"),
        F.col("sentiment").alias("local_sentiment"), F.col("confidence").alias("local_confidence"),
        asked.alias("review_requested"), F.array_join("reasons", "|").alias("review_reasons"), state.alias("review_state"),
        F.when(answered, F.col("_review.sentiment")).alias("review_sentiment"),
        F.when(seen, F.col(prefix + "provider")).alias("review_provider"), F.when(seen, F.col(prefix + "model")).alias("review_model"),
        F.when(seen, F.col(prefix + "latency_ms")).alias("review_latency_ms"),
        (asked & ~answered).alias("fallback_used"), code.alias("review_error_code"),
        (asked & called).alias("call_made"),
    )
    return trace


def provider_status(state: Column, error_code: Column) -> Column:
    return (
        F.when(state == "local_only", "not_requested").when(state.isin("reviewed", "disagreement"), "reviewed")
        .otherwise(F.coalesce(error_code, F.lit("provider_error")))
    )


def hybrid_summary(results: DataFrame, group_cols: Sequence[str] = (), unit_cost: float = C.REVIEW_COST_USD) -> DataFrame:
    """Eight summary fields per batch."""
    state = F.col("review_state")
    over = F.coalesce(F.col("review_error_code") == "review_budget_exceeded", F.lit(False))
    attempted = F.count_if("review_requested") - F.count_if(over)
    return results.groupBy(*group_cols).agg(
        F.count_if("review_requested").alias("review_requested"), attempted.alias("reviews_attempted"),
        F.count_if(over).alias("review_budget_exceeded"), F.count_if(state == "local_only").alias("local_only"),
        F.count_if(state == "reviewed").alias("reviewed"), F.count_if(state == "disagreement").alias("disagreement"),
        F.count_if(state == "fallback_local").alias("fallback"), F.round(attempted * unit_cost, 6).alias("estimated_cost_usd"))


# --- multilingual preparation ---------------------------------------------------------

def wants_translation(enabled: bool = True) -> Column:
    """Rows detected in a supported language other than Spanish."""
    asked = (F.col("language_status") == "detected") & (F.col("detected_language") != "es")
    return asked & F.lit(enabled)


def preparation_state(enabled: bool, detector: bool, translator: bool, granted: Column, success: Column, error: Column) -> tuple[Column, Column]:
    """(translation_state, translation_error_code) of one row."""
    if not enabled:
        return F.lit("not_needed"), F.lit(None).cast("string")
    if not detector:
        return F.lit("detection_error"), F.lit("unavailable")
    status = F.col("language_status")
    asked = wants_translation()
    given = asked & granted if translator else F.lit(False)
    state = (
        F.when(status.isin("unknown", "error"), "detection_error").when(status == "unsupported", "unsupported_language")
        .when(~asked, "not_needed").when(given & success, "translated").otherwise("fallback_original")
    )
    refused = "external_budget_exceeded" if translator else "unavailable"
    code = (
        F.when(status == "unknown", "undetectable_text").when(status == "error", "detector_error")
        .when(asked & ~given, refused).when(asked & ~success, F.coalesce(error, F.lit("provider_error")))
    )
    return state, code


# --- direct one-call reviews -------------------------------------------------------------

def direct_flags(text: Column) -> tuple[Column, Column]:
    """(is short, goes to the direct reviewer); needs detection columns beside."""
    short = tx.token_count(text) <= C.SHORT_TEXT_TOKENS
    foreign = (F.col("language_status") == "detected") & F.col("detected_language").isin(list(C.TRANSLATABLE_LANGUAGES))
    return short, short | F.coalesce(foreign, F.lit(False))
