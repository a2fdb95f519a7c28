"""Annotation QA: packet and master validation, agreement of two annotators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions import text as tx
from vozlake.operators import joins

Rule = tuple[str, Column]


def header_violations(columns: Sequence[str], expected: Sequence[str]) -> list[str]:
    """Schema-level findings: exact order, and no prediction columns."""
    found = []
    if list(columns) != list(expected):
        found.append("header_order")
    if set(columns) & set(C.PROHIBITED_COLUMNS):
        found.append("header_forbidden")
    return found


def is_utc_timestamp(value: Column) -> Column:
    """ISO-8601 text that ends in Z and parses once the Z is dropped."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?)?)?Z$"
    body = F.regexp_replace(value, "Z$", "")
    return F.coalesce(value.rlike(iso) & body.try_cast("timestamp_ntz").isNotNull(), F.lit(False))


def _col(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _one_of(value: Column, allowed: Sequence[str]) -> Column:
    return value.isin(list(allowed))


def _full(value: Column, pattern: str) -> Column:
    """Whole-value match; a bare ``$`` would let a trailing line break through."""
    return value.rlike(pattern.removesuffix("$") + r"\z")


def pattern_rules() -> list[Rule]:
    rules = [(f"invalid_{f}", ~_full(tx.strip(_col(f)), C.IDENTIFIER_PATTERN)) for f in ("case_id", "source_id", "family_id")]
    return [*rules, ("invalid_language", ~_full(_col("language"), C.LANGUAGE_TAG_PATTERN))]


def text_rules() -> list[Rule]:
    text = tx.strip(_col("texto_original_anonimizado"))
    return [("text_too_short", F.length(text) < C.MIN_TEXT_CHARS),
            *[(f"unredacted_{kind}", text.rlike(p)) for kind, p in tx.PII_KINDS.items()]]


def blind_domain_rules() -> list[Rule]:
    label = tx.strip(_col("annotator_label"))
    return [("invalid_source_type", ~_one_of(_col("source_type"), C.SOURCE_TYPES)),
            ("invalid_annotator_label", (label != "") & ~_one_of(label, C.ANNOTATION_LABELS)),
            ("invalid_sentiment_subgroup", ~_one_of(tx.strip(_col("sentiment_subgroup")), C.SUBGROUPS))]


def taxonomy_rules() -> list[Rule]:
    return [("taxonomy_version", tx.strip(_col("taxonomy_version")) != C.TAXONOMY_VERSION)]


def uncertainty_rules() -> list[Rule]:
    label = tx.strip(_col("annotator_label"))
    return [("uncertainty_reason_required", _one_of(label, ("Ambiguo", "No evaluable")) & (tx.strip(_col("uncertainty_reason")) == ""))]


def master_domain_rules() -> list[Rule]:
    first, second, final = _col("annotator_1_label"), _col("annotator_2_label"), _col("adjudicated_label")
    return [("invalid_source_type", ~_one_of(_col("source_type"), C.SOURCE_TYPES)),
            ("invalid_sentiment_subgroup", ~_one_of(_col("sentiment_subgroup"), C.SUBGROUPS)),
            ("invalid_annotation_status", ~_one_of(_col("annotation_status"), C.ANNOTATION_STATUSES)),
            ("invalid_split", ~_one_of(_col("split"), C.SPLITS)),
            ("invalid_annotator_1_label", (first != "") & ~_one_of(first, C.ANNOTATION_LABELS)),
            ("invalid_annotator_2_label", (second != "") & ~_one_of(second, C.ANNOTATION_LABELS)),
            ("invalid_adjudicated_label", (final != "") & ~_one_of(final, C.FINAL_LABELS))]


def created_at_rules() -> list[Rule]:
    return [("created_at", ~is_utc_timestamp(_col("created_at")))]


def status_rules() -> list[Rule]:
    status, first, second, final = (_col(c) for c in ("annotation_status", "annotator_1_label", "annotator_2_label", "adjudicated_label"))
    unresolved = (first == "") | (first != second) | ~_one_of(first, C.FINAL_LABELS) | (final != "")
    same_clear = (first == second) & (first != "Ambiguo")
    return [
        ("pending_with_labels", (status == "pending") & ((first != "") | (second != "") | (final != ""))),
        ("annotated_unresolved", (status == "annotated") & unresolved),
        ("disagreement_without_conflict", (status == "disagreement") & ((first == "") | (second == "") | same_clear)),
        ("disagreement_adjudicated", (status == "disagreement") & (final != "")),
        ("disagreement_reason_required", (status == "disagreement") & (tx.strip(_col("disagreement_reason")) == "")),
        ("adjudicated_incomplete", (status == "adjudicated") & (
            (first == "") | (second == "") | (final == "") | (tx.strip(_col("adjudication_notes")) == ""))),
        ("excluded_split", (status == "excluded") & (_col("split") != "excluded")),
    ]


def split_rules() -> list[Rule]:
    status, split = _col("annotation_status"), _col("split")
    resolved = F.when(status == "adjudicated", _col("adjudicated_label")).when(status == "annotated", _col("annotator_1_label")).otherwise("")
    return [("final_needs_resolution", (split == "final") & ~status.isin("annotated", "adjudicated")),
            ("not_evaluable_outside_excluded", (resolved == "No evaluable") & (split != "excluded")),
            ("synthetic_in_evaluation", (_col("source_type") == "synthetic") & split.isin("development", "final"))]


def row_violations(df: DataFrame, rules: Sequence[Rule], key: str = "row_number") -> DataFrame:
    """(key, rule) for every broken rule; one pass whatever the number of rules."""
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    found = df.select(key, F.explode_outer(broken).alias("rule"))
    return found.filter(F.col("rule").isNotNull())


def identifier_violations(df: DataFrame, key: str = "row_number", blank_counts: bool = True) -> DataFrame:
    """Blank ids, and every occurrence of an id after its first row.

    The first row of each repeated id is found by a combinable minimum, so a heavy
    repeated id is never ranked in one task.
    """
    ids = df.select(key, tx.strip(_col("case_id")).alias("case_id"))
    first = ids.groupBy("case_id").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    later = ids.join(first, "case_id").filter(F.col(key) > F.col("_first")).select(key)
    if blank_counts:
        blank = ids.filter("case_id = ''").select(key)
        later = later.unionByName(blank).distinct()
    return later.withColumn("rule", F.lit("case_id_blank_or_duplicated" if blank_counts else "case_id_duplicated"))


def family_leaks(df: DataFrame) -> DataFrame:
    """Families that appear in both development and final."""
    used = df.filter(F.col("split").isin("development", "final"))
    return used.groupBy("family_id").agg(
        F.max((F.col("split") == "development").cast("int")).alias("_d"), F.max((F.col("split") == "final").cast("int")).alias("_f"),
        F.count(F.lit(1)).alias("rows")).filter("_d = 1 and _f = 1").select("family_id", "rows")


def blind_rules() -> list[Rule]:
    return [*pattern_rules(), *text_rules(), *blind_domain_rules(), *taxonomy_rules(), *uncertainty_rules()]


def master_rules() -> list[Rule]:
    taxonomy = [("taxonomy_version", _col("taxonomy_version") != C.TAXONOMY_VERSION)]
    return [*pattern_rules(), *text_rules(), *master_domain_rules(), *created_at_rules(), *taxonomy, *status_rules(), *split_rules()]


def validate(df: DataFrame, mode: str, key: str = "row_number") -> DataFrame:
    """All findings of a blind packet or a master; no rows means valid."""
    if mode not in ("blind", "master"):
        raise ValueError("mode is blind or master")
    columns = [c for c in df.columns if c != key]
    expected = C.BLIND_COLUMNS if mode == "blind" else C.MASTER_COLUMNS
    header = header_violations(columns, expected)
    if header:
        return df.sparkSession.createDataFrame([("header", h) for h in header], "subject string, rule string")
    rules: Callable[[], list[Rule]] = blind_rules if mode == "blind" else master_rules
    rows = row_violations(df, rules(), key).unionByName(identifier_violations(df, key, mode == "blind"))
    found = rows.select(F.concat(F.lit("row "), F.col(key)).alias("subject"), "rule")
    if mode == "master":
        leaks = family_leaks(df).select(F.concat(F.lit("family "), F.col("family_id")).alias("subject"), F.lit("family_spans_splits").alias("rule"))
        found = found.unionByName(leaks)
    return found


def check_pair(first: DataFrame, second: DataFrame, key: str = "row_number") -> DataFrame:
    """(step, subject, problem): findings of either blind packet, or, once both are valid, how their cases differ.

    Two packets are compared only when neither has a finding, as a repeated or unreadable case has no one counterpart.
    """
    named = [validate(p, "blind", key).select(F.lit(f"packet_{n}").alias("step"), "subject", F.col("rule").alias("problem"))
             for n, p in (("a", first), ("b", second))]
    findings = cut(named[0].unionByName(named[1]), "findings")
    if not findings.isEmpty():
        return findings
    compared = joins.compare_packets(first, second)
    return compared.select(F.lit("comparison").alias("step"), F.col("case_id").alias("subject"), F.concat_ws(":", "problem", "fields").alias("problem"))


# --- agreement ----------------------------------------------------------------------------

def label_pairs(first: DataFrame, second: DataFrame, key: str = "case_id", label: str = "annotator_label") -> DataFrame:
    return joins.ids_in_both(first, second, key, label)


def agreement(pairs: DataFrame, group_cols: Sequence[str] = (), labels: Sequence[str] = C.ANNOTATION_LABELS) -> DataFrame:
    """Overlap, raw agreement and Cohen's kappa per group.

    Marginals are at most a handful of counters, so kappa comes from one aggregate.
    """
    n = F.count(F.lit(1))
    counts = pairs.groupBy(*group_cols).agg(
        n.alias("completed_overlap"), F.count_if(F.col("label_a") == F.col("label_b")).alias("agreements"),
        *[F.count_if(F.col("label_a") == x).alias(f"_a{k}") for k, x in enumerate(labels)],
        *[F.count_if(F.col("label_b") == x).alias(f"_b{k}") for k, x in enumerate(labels)])
    size = F.nullif(F.col("completed_overlap"), F.lit(0))
    observed = F.col("agreements") / size
    chance = sum((F.col(f"_a{k}") * F.col(f"_b{k}") for k in range(1, len(labels))), F.col("_a0") * F.col("_b0")) / (size * size)
    kappa = F.when(chance < 1, (observed - chance) / F.nullif(1 - chance, F.lit(0.0))).when(observed == 1, F.lit(1.0))
    return counts.select(*group_cols, "completed_overlap", F.round(observed, 6).alias("raw_agreement"), F.round(kappa, 6).alias("cohen_kappa"))


def agreement_matrix(pairs: DataFrame, labels: Sequence[str] = C.ANNOTATION_LABELS) -> DataFrame:
    """Dense label matrix; rows are annotator A."""
    cells = pairs.agg(*[
        F.count_if((F.col("label_a") == a) & (F.col("label_b") == b)).alias(f"n{i}_{j}")
        for i, a in enumerate(labels) for j, b in enumerate(labels)])
    return cells.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), F.col(f"n{i}_{j}").alias("n"))
        for i, a in enumerate(labels) for j, b in enumerate(labels)])))


def prevalence(pairs: DataFrame, labels: Sequence[str] = C.ANNOTATION_LABELS) -> DataFrame:
    """Uses of every label by each annotator; a label that is never used counts zero."""
    uses = [(who, x, f"{col}_{k}", F.count_if(F.col(col) == x)) for who, col in (("annotator_A", "label_a"), ("annotator_B", "label_b"))
            for k, x in enumerate(labels)]
    counts = pairs.agg(*[n.alias(name) for _, _, name, n in uses])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(who).alias("annotator"), F.lit(x).alias("label"), F.col(name).alias("n")) for who, x, name, _ in uses])))
