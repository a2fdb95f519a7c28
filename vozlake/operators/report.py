"""Report facts: batch aggregates as typed, linked rows, and what they allow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions.text import let
from vozlake.operators import metrics as mt
from vozlake.operators import ranking, topics

_ANALYSED = "comments analysed in the batch"
_FINAL = "comments with a final class"
_LOCAL = "local scores of the batch"
_TERMS = "selected terms of negative comments"
COUNT_FACTS = ("dataset.total_comments", "sentiment.negative.count", "lexical.selected_frequency_sum",
               "technical.high_confidence_negative.count")


def batch_tables(scored: DataFrame, group_cols: Sequence[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(metrics, Pareto) of scored comments that are read and scored once.

    What is stored keeps the text of negative comments only. The two results hold a
    few rows per batch and every report reads both, so they are stored as well.
    """
    narrow = cut(scored.select(
        *group_cols, "sentiment", "confidence", F.when(F.col("sentiment") == C.NEGATIVE, F.col(text_col)).alias("text")))
    return cut(mt.sentiment_metrics(narrow, group_cols)), cut(topics.negative_topics(narrow, group_cols))


def with_batch(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Put two tables of one row per batch side by side; without batches each is one row."""
    if groups:
        return ranking.join_groups(left, right, groups, "left")
    return ranking.join_groups(left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), ["_one"], "left").drop("_one")


def _fact(fact_id: str | Column, value: Column, display: Column, unit: str, population: str, definition: str,
          numerator: str | Column | None = None, denominator: str | None = None, text: Column | None = None) -> Column:
    def lit(v: str | Column | None) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    return F.struct(
        lit(fact_id).alias("fact_id"), value.cast("double").alias("value_num"), display.cast("double").alias("value_display"),
        (text if text is not None else F.lit(None).cast("string")).alias("value_text"), F.lit(unit).alias("unit"),
        F.lit(population).alias("population"), F.lit(definition).alias("definition"),
        lit(numerator).alias("numerator_fact"), lit(denominator).alias("denominator_fact"))


def facts(metrics: DataFrame, pareto: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Long fact registry per batch; at most 13 + 45 rows each."""
    groups = list(group_cols)
    lexical = pareto.groupBy(*groups).agg(
        F.sum("frequency").alias("_sum"), F.count_if("within_80_percent").alias("_block"))
    base = with_batch(metrics, lexical, groups)
    rows = []

    def whole(fact_id: str, value: Column, unit: str, population: str, definition: str) -> None:
        rows.append(_fact(fact_id, value, value, unit, population, definition))

    whole("dataset.total_comments", F.col("total"), "comments", _ANALYSED, "Comments in this analysis.")
    for slug in C.CLASS_SLUGS.values():
        whole(f"sentiment.{slug}.count", F.col(f"{slug}_count"), "comments", _FINAL, f"Comments whose final class is {slug}.")
        share = F.col(f"{slug}_percentage")
        rows.append(_fact(f"sentiment.{slug}.share", share, F.round(share, 2), "percent", _FINAL,
                          f"Percentage of comments whose final class is {slug}.", f"sentiment.{slug}.count", "dataset.total_comments"))
    ratio = F.col("positive_negative_ratio")
    finite = F.when(ratio != float("inf"), ratio)
    rows.append(_fact("sentiment.positive_negative_ratio", finite, F.round(finite, 6), "positive_comments_per_negative_comment", _FINAL,
                      "Positive comments for each negative one.", "sentiment.positive.count", "sentiment.negative.count",
                      F.when(ratio == float("inf"), F.lit("undefined_no_negative_comments"))))
    rows.append(_fact("model.mean_local_confidence", F.col("mean_confidence"), F.round("mean_confidence", 4), "probability", _LOCAL,
                      "Mean confidence of the local scorer. It says nothing about correctness."))
    limit = F.col("critical_confidence_threshold")
    rows.append(_fact("technical.high_confidence_negative.threshold", F.round(limit, 6), F.round(limit, 4), "probability", _LOCAL,
                      "Upper quartile of local confidence in the batch."))
    whole("technical.high_confidence_negative.count", F.col("critical_negative_count"), "comments", "negative comments of the batch",
          "Negative comments at or above the upper quartile of confidence. A technical signal only.")
    whole("lexical.selected_frequency_sum", F.coalesce("_sum", F.lit(0)), "selected_ngram_document_mentions", _TERMS,
          "Sum of document frequencies of the selected terms.")
    whole("lexical.pareto_block_term_count", F.coalesce("_block", F.lit(0)), "selected_ngrams", _TERMS, "Selected terms inside the Pareto block.")
    fixed = base.select(*groups, F.inline(F.array(*rows)))

    name = F.concat(F.lit("lexical.rank."), F.col("rank"))
    frequency_id = F.concat(name, F.lit(".frequency"))
    mentions = "document mentions of selected terms"
    ranked = pareto.filter(F.col("rank") <= C.MAX_TOPICS).select(*groups, F.inline(F.array(
        _fact(frequency_id, F.col("frequency"), F.col("frequency"), "selected_ngram_document_mentions", _TERMS, "Comments that hold this term."),
        _fact(F.concat(name, F.lit(".share")), F.col("percentage"), F.round("percentage", 2), "percent", mentions,
              "Share of this term in all mentions.", frequency_id, "lexical.selected_frequency_sum"),
        _fact(F.concat(name, F.lit(".cumulative_share")), F.col("cumulative_percentage"), F.round("cumulative_percentage", 2), "percent", mentions,
              "Running share up to this term.", None, "lexical.selected_frequency_sum"))))
    return fixed.unionByName(ranked)


def lineage(registry: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Facts with both links: do the linked facts exist, and does the value follow?"""
    groups = list(group_cols)
    linked = registry.filter("numerator_fact is not null and denominator_fact is not null")
    values = registry.select(*groups, "fact_id", "value_num")
    top = values.select(*groups, F.col("fact_id").alias("numerator_fact"), F.col("value_num").alias("_n"), F.lit(True).alias("_has_n"))
    bottom = values.select(*groups, F.col("fact_id").alias("denominator_fact"), F.col("value_num").alias("_d"), F.lit(True).alias("_has_d"))
    joined = linked.join(top, [*groups, "numerator_fact"], "left").join(bottom, [*groups, "denominator_fact"], "left")
    scale = F.when(F.col("unit") == "percent", 100.0).otherwise(1.0)
    expected = F.col("_n") * scale / F.nullif(F.col("_d"), F.lit(0.0))
    return joined.select(
        *groups, "fact_id", (F.coalesce("_has_n", F.lit(False)) & F.coalesce("_has_d", F.lit(False))).alias("links_exist"),
        # a value with a missing link follows from nothing
        F.coalesce(F.abs(F.col("value_num") - expected) < 1e-5, F.col("value_num").isNull() | (F.col("_d") == 0), F.lit(False)).alias("value_follows"))


def deciding_counts(registry: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return registry.filter(F.col("fact_id").isin(list(COUNT_FACTS))).groupBy(*group_cols).agg(*[
        F.max(F.when(F.col("fact_id") == f, F.col("value_num"))).alias(f"_f{k}") for k, f in enumerate(COUNT_FACTS)])


def capability_flags(available: Mapping[str, bool] | None = None) -> dict[str, bool]:
    """What a report can rely on beyond the facts; nothing unless stated."""
    unknown = set(available or {}) - set(C.CAPABILITIES)
    if unknown:
        raise ValueError(f"unknown capabilities: {sorted(unknown)}")
    return {c: bool((available or {}).get(c, False)) for c in C.CAPABILITIES}


def capabilities(registry: DataFrame, group_cols: Sequence[str], available: Mapping[str, bool] | None = None) -> DataFrame:
    """(batch, capability, available): five flags per batch."""
    flags = [F.struct(F.lit(c).alias("capability"), F.lit(on).alias("available")) for c, on in capability_flags(available).items()]
    return registry.select(*group_cols).distinct().select(*group_cols, F.inline(F.array(*flags)))


def eligible(registry: DataFrame, group_cols: Sequence[str], available: Mapping[str, bool] | None = None) -> DataFrame:
    """(batch, kind, id) of the catalog entries that the facts and the capabilities allow."""
    flags = capability_flags(available)

    def allowed(fact: str | None, rule: str) -> Column:
        if rule == "always":
            return F.lit(True)
        if rule == "absent":
            return F.lit(not flags[fact])
        value = F.col(f"_f{COUNT_FACTS.index(fact)}")
        return value > 0 if rule == "positive" else value == 0

    options = [
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("id"), allowed(fact, rule).alias("ok"))
        for kind, name, fact, rule in C.ELIGIBILITY_RULES]
    return deciding_counts(registry, group_cols).select(*group_cols, F.inline(F.array(*options))).filter("ok").drop("ok")


def eligible_arrays(registry: DataFrame, group_cols: Sequence[str], available: Mapping[str, bool] | None = None) -> DataFrame:
    """One row per batch: allowed ids per kind and existing fact ids (tens of entries)."""
    ids = eligible(registry, group_cols, available).groupBy(*group_cols).agg(*[
        F.array_sort(F.array_agg(F.when(F.col("kind") == k, F.col("id")))).alias(f"allowed_{k}")
        for k in ("interpretation", "hypothesis", "recommendation", "insufficient")])
    known = registry.groupBy(*group_cols).agg(F.array_sort(F.array_agg("fact_id")).alias("known_facts"))
    return with_batch(ids, known, list(group_cols))


def opportunity_band(negative_share: Column) -> Column:
    return F.when(negative_share >= 40, "high").when(negative_share >= 20, "relevant").otherwise("contained")


def _money(value: Column, digits: int = 2) -> Column:
    return F.round(value, digits).cast(f"decimal(18,{digits})").cast("string")


def report_lines(metrics: DataFrame, pareto: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Deterministic report of a batch: (section, line_no, line)."""
    groups = list(group_cols)
    block = pareto.groupBy(*groups).agg(F.count_if("within_80_percent").alias("_block"))
    base = with_batch(metrics, block, groups)
    count = F.coalesce("_block", F.lit(0))
    ratio = F.col("positive_negative_ratio")
    band = opportunity_band(F.col("negative_percentage"))
    advice = F.element_at(F.create_map(
        F.lit("high"), F.lit("Revise los términos frecuentes y una muestra amplia de comentarios negativos."),
        F.lit("relevant"), F.lit("Revise los términos dominantes y valide sus grupos a mano."),
        F.lit("contained"), F.lit("Revise una muestra de los comentarios negativos.")), band)

    def line(section: str, number: int, *parts: str | Column) -> Column:
        text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        return F.struct(F.lit(section).alias("section"), F.lit(number).alias("line_no"), text.alias("line"))

    def of(label: str, slug: str, number: int) -> Column:
        return line("distribution", number, f"{label}: ", F.col(f"{slug}_count").cast("string"), " (", _money(F.col(f"{slug}_percentage")), " %)")

    rows = [
        line("summary", 1, "Comentarios analizados: ", F.col("total").cast("string")),
        line("summary", 2, "Confianza media: ", _money(F.col("mean_confidence"), 4)),
        of("Positivos", "positive", 1), of("Neutros", "neutral", 2), of("Negativos", "negative", 3),
        line("distribution", 4, "Positivos por negativo: ", F.when(ratio == float("inf"), "sin negativos").otherwise(
            F.when(ratio != float("inf"), _money(F.when(ratio != float("inf"), ratio))))),
        line("pareto", 1, F.when(count > 0, F.concat(F.lit("Términos del bloque: "), count.cast("string"))).otherwise("Sin términos negativos")),
        line("opportunity", 1, advice),
        line("limits", 1, "Los términos son n-gramas y la confianza no mide acierto."),
    ]
    fixed = base.select(*groups, F.inline(F.array(*rows)))
    named = pareto.filter("rank <= 3").select(*groups, F.inline(F.array(F.struct(
        F.lit("topics").alias("section"), F.col("rank").alias("line_no"),
        F.concat(F.col("topic"), F.lit(": "), F.col("frequency").cast("string"), F.lit(" menciones")).alias("line")))))
    return fixed.unionByName(named)


def dashboard(metrics: DataFrame, pareto: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """One wide row per batch with the three leading topics."""
    groups = list(group_cols)
    leading = pareto.groupBy(*groups).agg(
        F.count_if("within_80_percent").alias("priority_topic_count"),
        F.array_join(F.transform(F.array_sort(F.array_agg(F.when(F.col("rank") <= 3, F.struct("rank", "topic", "frequency")))),
                                 lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["topic"], F.lit("="), x["frequency"].cast("string"))), "|").alias("topics"))
    base = with_batch(metrics, leading, groups)
    ratio = F.col("positive_negative_ratio")
    return base.select(
        *groups, "total", "positive_count", "positive_percentage", "negative_count", "negative_percentage", "mean_confidence",
        "critical_negative_count", "critical_confidence_threshold", F.when(ratio != float("inf"), ratio).alias("ratio"),
        F.coalesce("priority_topic_count", F.lit(0)).alias("priority_topic_count"), F.coalesce("topics", F.lit("")).alias("topics"))


_EVIDENCE = ("fact_id", "value_display", "value_text", "unit", "population", "numerator_fact", "denominator_fact")


def evidence_payload(registry: DataFrame, group_cols: Sequence[str], available: Mapping[str, bool] | None = None) -> DataFrame:
    """Aggregate-only JSON per batch: facts, capabilities, allowed ids, limits. No comment text or topics."""
    groups = list(group_cols)
    listed = registry.groupBy(*groups).agg(F.array_sort(F.array_agg(F.struct(*_EVIDENCE))).alias("facts"))
    allowed = eligible_arrays(registry, groups, available).drop("known_facts")
    flags = F.struct(*[F.lit(on).alias(c) for c, on in capability_flags(available).items()])
    joined = with_batch(listed, allowed, groups)
    kinds = [c for c in allowed.columns if c not in groups]
    limits = F.struct(*[F.lit(v).alias(k) for k, v in C.READING_LIMITS.items()])
    payload = F.to_json(F.struct(
        F.lit(C.READING_SCHEMA_VERSION).alias("schema_version"), limits.alias("limits"), flags.alias("capabilities"), F.struct(*kinds).alias("eligible"), F.col("facts")))
    return joined.select(*groups, payload.alias("payload"))


def read_payload(payloads: DataFrame, group_cols: Sequence[str], payload: str = "payload") -> DataFrame:
    """A payload read back as rows (batch, part, name, value, text): its version, limits, capabilities, allowed ids and facts."""
    kinds = ("interpretation", "hypothesis", "recommendation", "insufficient")
    shape = ("schema_version string, limits map<string,bigint>, capabilities map<string,boolean>, eligible struct<"
             + ",".join(f"allowed_{k}:array<string>" for k in kinds)
             + ">, facts array<struct<fact_id:string,value_display:double,value_text:string,numerator_fact:string,denominator_fact:string>>")
    none = F.lit(None)

    def row(part: str | Column, name: Column, value: Column = none, text: Column = none) -> Column:
        return F.struct((F.lit(part) if isinstance(part, str) else part).alias("part"), name.alias("name"),
                        value.cast("double").alias("value"), text.cast("string").alias("text"))

    def ids(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: row(kind, v))

    def entries(doc: Column) -> Column:
        return F.concat(
            F.array(row("schema_version", doc["schema_version"])),
            F.transform(F.map_entries(doc["limits"]), lambda e: row("limit", e["key"], e["value"])),
            F.transform(F.map_entries(doc["capabilities"]), lambda e: row("capability", e["key"], e["value"].cast("int"))),
            *[ids(k, doc["eligible"][f"allowed_{k}"]) for k in kinds],
            F.transform(doc["facts"], lambda f: row("fact", f["fact_id"], f["value_display"], F.concat_ws(
                "|", F.coalesce(f["value_text"], F.lit("")), F.coalesce(f["numerator_fact"], F.lit("")), F.coalesce(f["denominator_fact"], F.lit(""))))))

    return payloads.select(*group_cols, F.inline(let(F.from_json(payload, shape), entries)))


def payload_size(payload: Column) -> Column:
    """struct<characters, approximate_tokens>."""
    return let(F.length(payload), lambda n: F.struct(
        n.alias("characters"), F.greatest(F.lit(1), F.floor(n / 4).cast("int")).alias("approximate_tokens")))
