"""Ids and references of every list of a selection against the catalog and the batch's facts."""

import json

from vozlake.operators import selection


def test_all_lists_and_references(spark):
    raw = {
        "interpretations": [
            {"interpretation_id": "review_negative_distribution", "fact_refs": ["sentiment.negative.count", "lexical.selected_frequency_sum", "made.up"]},
            {"interpretation_id": "invented", "fact_refs": []}],
        "hypotheses": [
            {"hypothesis_id": "negative_predictions_may_include_model_errors", "fact_refs": ["sentiment.negative.count"], "validation_needed_id": "semantic_category_validation"},
            {"hypothesis_id": "unknown", "fact_refs": ["sentiment.negative.count"], "validation_needed_id": 5}],
        "recommendation_ids": ["define_business_objectives", "no"], "evidence_needed_ids": ["temporal_baseline", "hearsay"],
        "insufficient_evidence_ids": [7]}
    allowed = spark.createDataFrame([(
        "a", ["review_negative_distribution"], ["negative_predictions_may_include_model_errors"], ["define_business_objectives"], ["no_business_targets"],
        ["sentiment.negative.count", "lexical.selected_frequency_sum"])],
        "source string, allowed_interpretation array<string>, allowed_hypothesis array<string>, allowed_recommendation array<string>, allowed_insufficient array<string>, known_facts array<string>")
    rows = [(1, "a", json.dumps(raw)), (2, "a", "not json"), (3, "a", "{}"), (4, "other", '{"recommendation_ids": ["no"], "hypotheses": {}}')]
    got = selection.catalog_violations(spark.createDataFrame(rows, "event_id long, source string, raw string"), allowed, ["source"], "event_id")
    assert {tuple(r) for r in got.select("event_id", "kind", "id", "ref", "rule").collect()} == {
        (1, "interpretation", "review_negative_distribution", "lexical.selected_frequency_sum", "ref_not_allowed"),
        (1, "interpretation", "review_negative_distribution", "made.up", "unknown_fact"),
        (1, "interpretation", "invented", None, "ineligible_id"), (1, "interpretation", "invented", None, "without_refs"),
        (1, "hypothesis", "negative_predictions_may_include_model_errors", "semantic_category_validation", "validation_not_allowed"),
        (1, "hypothesis", "unknown", None, "ineligible_id"), (1, "hypothesis", "unknown", "sentiment.negative.count", "ref_not_allowed"),
        (1, "hypothesis", "unknown", None, "validation_not_allowed"),
        (1, "recommendation", "no", None, "ineligible_id"), (1, "evidence", "hearsay", None, "ineligible_id"), (1, "insufficient", None, None, "ineligible_id"),
        (4, "recommendation", "no", None, "ineligible_id")}
