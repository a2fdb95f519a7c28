"""Values every job shares.

The blocks marked FIXED VALUES are data contracts: results only agree with
existing reports if these are kept exactly as they are.
"""

from __future__ import annotations

# --- FIXED VALUES: classes, in their reporting order -----------------------
NEGATIVE, NEUTRAL, POSITIVE = "Negativo", "Neutro", "Positivo"
CLASSES = (NEGATIVE, NEUTRAL, POSITIVE)
CLASS_SLUGS = {NEGATIVE: "negative", NEUTRAL: "neutral", POSITIVE: "positive"}

# --- FIXED VALUES: text limits ---------------------------------------------
MIN_TEXT_CHARS = 2
MAX_TEXT_CHARS = 5000
ANONYMIZED_CHARS = 240
SHORT_TEXT_TOKENS = 4

# --- FIXED VALUES: personal-data patterns ----------------------------------
EMAIL_PATTERN = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_PATTERN = r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"
URL_PATTERN = r"https?://\S+|www\.\S+"
LONG_ID_PATTERN = r"\b\d{6,}\b"

# --- FIXED VALUES: Spanish negation words ----------------------------------
NEGATION_WORDS = ("no", "nunca", "nadie", "sin", "tampoco", "ni", "jamas", "jamás")

#: words that set one part of a comment against another
CONTRAST_WORDS = ("pero", "aunque", "sin embargo", "no obstante", "but", "although", "however", "aber", "obwohl", "mais", "cependant")

# --- FIXED VALUES: stop words of the topic report --------------------------
TOPIC_STOP_WORDS = tuple(
    """
    a al algo algunas algunos ante antes as at aunque be been being but by cada como con contra cual
    cuando da das de del desde do dos e el ela elas ele eles em en entre era es esa ese eso esta estaba
    este eu foi for from fue ha hay i in is it la las le les lo los mais mas me mi muy na nao no nos nossa
    o of on or os ou para pero por porque que se sem ser si sin sobre su sus the to tu um uma un una unos
    y ya yo you your muito producto product servico servicio service compra pedido order
    """.split()
)

# --- FIXED VALUES: topics and Pareto ---------------------------------------
MAX_TOPICS = 15
PARETO_THRESHOLD = 0.80

# --- FIXED VALUES: text model hyper-parameters -----------------------------
TFIDF_MIN_DF = 3
TFIDF_MAX_DF = 0.9
TFIDF_MAX_FEATURES = 5000

# --- FIXED VALUES: routing --------------------------------------------------
GLOBAL_THRESHOLD = 0.80
CLASS_THRESHOLDS = {NEGATIVE: 0.80, NEUTRAL: 0.65, POSITIVE: 0.80}
MARGIN_SWEEP = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
ABSTENTION_SWEEP = (0.50, 0.60, 0.70, 0.80)
ROUTING_SIGNALS = (
    "low_confidence",
    "small_margin",
    "possible_factual_neutral",
    "possible_out_of_domain",
    "language_mismatch",
)
MAX_REVIEWS_PER_BATCH = 25
REVIEW_COST_USD = 0.000178
INPUT_TOKEN_COST_USD = 0.00000035
OUTPUT_TOKEN_COST_USD = 0.00000075

# --- FIXED VALUES: call pacing ----------------------------------------------
PACING_REQUESTS = 5
PACING_WINDOW_SECONDS = 60.0
PACING_MARGIN_SECONDS = 2.0
CLEAN_WINDOW_SECONDS = 61.0

# --- FIXED VALUES: languages ------------------------------------------------
SUPPORTED_LANGUAGES = {"es": "Español", "en": "Inglés", "pt": "Portugués", "it": "Italiano"}
TRANSLATABLE_LANGUAGES = ("en", "pt", "it")

# --- FIXED VALUES: states ---------------------------------------------------
REVIEW_STATES = ("local_only", "review_requested", "reviewed", "disagreement", "fallback_local")
LANGUAGE_STATUSES = ("detected", "unsupported", "unknown", "error")
TRANSLATION_STATES = (
    "not_needed", "translated", "fallback_original", "unsupported_language", "detection_error",
)
DIRECT_STATES = ("local_only", "direct_multilingual_review", "direct_review_failed")

# --- FIXED VALUES: normalised terms looked up in the coefficient table ------
COMMERCIAL_TERMS = (
    "compra", "devolucion", "devolución", "entrega", "factura", "garantia",
    "garantía", "pedido", "problema", "producto", "reintegro", "soporte",
)

# --- FIXED VALUES: annotation contract --------------------------------------
TAXONOMY_VERSION = "sentiment-v1.0.0"
ANNOTATION_LABELS = ("Negativo", "Neutro", "Positivo", "No evaluable", "Ambiguo")
FINAL_LABELS = ("Negativo", "Neutro", "Positivo", "No evaluable")
SOURCE_TYPES = ("authorized_feedback", "public_dataset", "synthetic")
ANNOTATION_STATUSES = ("pending", "annotated", "disagreement", "adjudicated", "excluded")
SPLITS = ("unassigned", "development", "final", "training_only", "excluded")
LANGUAGE_TAG_PATTERN = r"^[a-z]{2,3}(?:-[A-Z]{2})?$"
IDENTIFIER_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{2,63}$"
SUBGROUPS = (
    "factual", "explicit_opinion", "weak_opinion", "mixed", "simple_negation",
    "polarity_inverting_negation", "double_negation", "contrast", "sarcasm",
    "short", "multi_sentence", "resolved_problem", "praise_with_problem",
    "out_of_domain", "other",
)
BLIND_COLUMNS = (
    "case_id", "texto_original_anonimizado", "source_id", "family_id",
    "source_type", "language", "sentiment_subgroup", "annotator_label",
    "uncertainty_reason", "annotator_notes", "taxonomy_version",
)
MASTER_COLUMNS = (
    "case_id", "texto_original_anonimizado", "source_id", "family_id", "source_type",
    "language", "annotation_status", "annotator_1_label", "annotator_2_label",
    "adjudicated_label", "disagreement_reason", "adjudication_notes",
    "sentiment_subgroup", "created_at", "taxonomy_version", "split",
)
PROHIBITED_COLUMNS = (
    "prediction", "predicted_sentiment", "model_prediction", "confidence",
    "local_confidence", "probability_negativo", "probability_neutro",
    "probability_positivo", "expected_sentiment",
)
PACKET_SHARED_FIELDS = (
    "texto_original_anonimizado", "source_id", "family_id", "source_type",
    "language", "sentiment_subgroup", "taxonomy_version",
)

# --- FIXED VALUES: journal and cost-log fields ------------------------------
COST_FIELDS = (
    "case_id", "architecture", "call_type", "input_tokens", "output_tokens", "total_tokens",
    "cost_usd", "latency_ms", "state", "error_code", "started_at", "completed_at",
)

# --- FIXED VALUES: assisted-reading contract --------------------------------
READING_SCHEMA_VERSION = "2.0"
READING_LIMITS = {
    "interpretations": 3, "hypotheses": 2, "recommendation_ids": 3,
    "evidence_needed_ids": 4, "insufficient_evidence_ids": 4, "fact_refs": 4,
}
INTERPRETATION_FACTS = {
    "review_negative_distribution": ("sentiment.negative.count", "sentiment.negative.share"),
    "lexical_concentration_for_review": ("lexical.selected_frequency_sum",),
    "confidence_requires_independent_evaluation": ("model.mean_local_confidence",),
    "technical_signal_requires_human_review": ("technical.high_confidence_negative.count",),
}
HYPOTHESIS_FACTS = {
    "lexical_patterns_may_reflect_shared_issue": ("lexical.selected_frequency_sum",),
    "negative_predictions_may_include_model_errors": ("sentiment.negative.count",),
    "technical_signal_may_support_sample_review": ("technical.high_confidence_negative.count",),
}
HYPOTHESIS_VALIDATIONS = {
    "lexical_patterns_may_reflect_shared_issue":
        ("qualitative_comment_review", "semantic_category_validation"),
    "negative_predictions_may_include_model_errors":
        ("independent_labeled_evaluation", "qualitative_comment_review"),
    "technical_signal_may_support_sample_review":
        ("qualitative_comment_review", "independent_labeled_evaluation"),
}
EVIDENCE_NEEDED_IDS = (
    "independent_labeled_evaluation", "qualitative_comment_review",
    "semantic_category_validation", "temporal_baseline", "business_objectives",
)
# (kind, id, fact that decides, rule) - rule "always", "positive" or "zero"
CAPABILITIES = ("semantic_categories", "unique_comment_union_by_terms", "time_comparison", "business_targets", "business_severity")

ELIGIBILITY_RULES = (
    ("interpretation", "confidence_requires_independent_evaluation", None, "always"),
    ("interpretation", "review_negative_distribution", "sentiment.negative.count", "positive"),
    ("interpretation", "lexical_concentration_for_review", "lexical.selected_frequency_sum", "positive"),
    ("interpretation", "technical_signal_requires_human_review",
     "technical.high_confidence_negative.count", "positive"),
    ("recommendation", "independent_model_evaluation", None, "always"),
    ("recommendation", "define_business_objectives", None, "always"),
    ("recommendation", "collect_temporal_baseline", "time_comparison", "absent"),
    ("recommendation", "review_negative_sample", "sentiment.negative.count", "positive"),
    ("recommendation", "investigate_causes_with_evidence", "sentiment.negative.count", "positive"),
    ("recommendation", "inspect_ranked_ngrams", "lexical.selected_frequency_sum", "positive"),
    ("recommendation", "validate_lexical_groups_manually", "lexical.selected_frequency_sum", "positive"),
    ("hypothesis", "negative_predictions_may_include_model_errors", "sentiment.negative.count", "positive"),
    ("hypothesis", "lexical_patterns_may_reflect_shared_issue", "lexical.selected_frequency_sum", "positive"),
    ("hypothesis", "technical_signal_may_support_sample_review",
     "technical.high_confidence_negative.count", "positive"),
    ("insufficient", "no_negative_comments", "sentiment.negative.count", "zero"),
    ("insufficient", "no_lexical_terms", "lexical.selected_frequency_sum", "zero"),
    ("insufficient", "no_semantic_categories", "semantic_categories", "absent"),
    ("insufficient", "no_time_comparison", "time_comparison", "absent"),
    ("insufficient", "no_business_targets", "business_targets", "absent"),
)

# Decimals of probabilities in the final rows of a registered query. Scores keep their
# full precision through ranking, thresholds, budgets and statistics.
PROBABILITY_DECIMALS = 6

# Python's str.strip()/isspace() set, used wherever blanks are trimmed or split.
WHITESPACE_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODEPOINTS))
