"""Queries over annotation packets and the annotation master."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.operators import annotation as an
from vozlake.operators import joins
from vozlake.plans import oracle as o
from vozlake.plans.registry import Tables, query


def rules_sql(table: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT row_number, '{name}' AS rule FROM {table} WHERE {test}" for name, test in rules.items())


def _s(column: str) -> str:
    return o.strip(f"coalesce({column}, '')")


_PATTERN = {**{f"invalid_{f}": f"NOT regexp_matches({_s(f)}, '{C.IDENTIFIER_PATTERN}')" for f in ("case_id", "source_id", "family_id")},
            "invalid_language": f"NOT regexp_matches(language, '{C.LANGUAGE_TAG_PATTERN}')"}
_TEXT_COL = "texto_original_anonimizado"
_TEXT = {
    "text_too_short": f"length({_s(_TEXT_COL)}) < 2",
    "unredacted_email": rf"regexp_matches({_TEXT_COL}, '(?i)[A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{{2,}}($|{o.NW})')",
    "unredacted_url": rf"regexp_matches({_TEXT_COL}, '(?i)https?://\S|www\.\S')",
    "unredacted_phone": rf"regexp_matches({_TEXT_COL}, '(^|{o.NW})\+?\p{{Nd}}[\p{{Nd}}\s().-]{{7,}}\p{{Nd}}($|{o.NW})')",
    "unredacted_long_numeric_id": rf"regexp_matches({_TEXT_COL}, '(^|{o.NW})\p{{Nd}}{{6,}}($|{o.NW})')",
}
_BLIND = {
    "invalid_source_type": f"source_type NOT IN ({o.words(C.SOURCE_TYPES)})",
    "invalid_annotator_label": f"{_s('annotator_label')} <> '' AND {_s('annotator_label')} NOT IN ({o.words(C.ANNOTATION_LABELS)})",
    "invalid_sentiment_subgroup": f"sentiment_subgroup NOT IN ({o.words(C.SUBGROUPS)})",
}
_TAXONOMY = {"taxonomy_version": f"taxonomy_version <> '{C.TAXONOMY_VERSION}'"}
_UNCERTAIN = {"uncertainty_reason_required": f"annotator_label IN ('Ambiguo', 'No evaluable') AND {_s('uncertainty_reason')} = ''"}
_MASTER = {
    "invalid_source_type": f"source_type NOT IN ({o.words(C.SOURCE_TYPES)})", "invalid_sentiment_subgroup": f"sentiment_subgroup NOT IN ({o.words(C.SUBGROUPS)})",
    "invalid_annotation_status": f"annotation_status NOT IN ({o.words(C.ANNOTATION_STATUSES)})", "invalid_split": f"split NOT IN ({o.words(C.SPLITS)})",
    "invalid_annotator_1_label": f"annotator_1_label NOT IN ('', {o.words(C.ANNOTATION_LABELS)})", "invalid_annotator_2_label": f"annotator_2_label NOT IN ('', {o.words(C.ANNOTATION_LABELS)})",
    "invalid_adjudicated_label": f"adjudicated_label NOT IN ('', {o.words(C.FINAL_LABELS)})",
}
_CREATED = {"created_at": "NOT (ends_with(created_at, 'Z') AND try_cast(created_at[:-2] AS TIMESTAMP) IS NOT NULL)"}
_STATUS = {
    "pending_with_labels": "annotation_status = 'pending' AND annotator_1_label || annotator_2_label || adjudicated_label <> ''",
    "annotated_unresolved": f"annotation_status = 'annotated' AND NOT (annotator_1_label = annotator_2_label AND annotator_1_label IN ({o.words(C.FINAL_LABELS)}) AND adjudicated_label = '')",
    "disagreement_without_conflict": "annotation_status = 'disagreement' AND NOT (annotator_1_label <> '' AND annotator_2_label <> '' AND (annotator_1_label <> annotator_2_label OR annotator_1_label = 'Ambiguo'))",
    "disagreement_adjudicated": "annotation_status = 'disagreement' AND adjudicated_label <> ''",
    "disagreement_reason_required": f"annotation_status = 'disagreement' AND {_s('disagreement_reason')} = ''",
    "adjudicated_incomplete": f"annotation_status = 'adjudicated' AND NOT (annotator_1_label <> '' AND annotator_2_label <> '' AND adjudicated_label <> '' AND {_s('adjudication_notes')} <> '')",
    "excluded_split": "annotation_status = 'excluded' AND split <> 'excluded'",
}
_SPLIT = {
    "final_needs_resolution": "split = 'final' AND annotation_status NOT IN ('annotated', 'adjudicated')",
    "not_evaluable_outside_excluded": "split <> 'excluded' AND ((annotation_status = 'adjudicated' AND adjudicated_label = 'No evaluable') OR (annotation_status = 'annotated' AND annotator_1_label = 'No evaluable'))",
    "synthetic_in_evaluation": "source_type = 'synthetic' AND split IN ('development', 'final')",
}
_IDS = """SELECT row_number, 'case_id_blank_or_duplicated' AS rule FROM (SELECT row_number, case_id, row_number() OVER (PARTITION BY case_id ORDER BY row_number) AS r FROM packet_a) WHERE case_id = '' OR r > 1"""
_MASTER_IDS = """SELECT row_number, 'case_id_duplicated' AS rule FROM (SELECT row_number, row_number() OVER (PARTITION BY case_id ORDER BY row_number) AS r FROM master) WHERE r > 1"""
_FAMILIES = "SELECT family_id, count(*) AS rows FROM master WHERE split IN ('development', 'final') GROUP BY 1 HAVING count(DISTINCT split) > 1"


@query("val_case_id", o.with_ctes(_IDS))
def val_case_id(t: Tables) -> DataFrame:
    return an.identifier_violations(t.derived("packet_a"))


@query("val_patterns", o.with_ctes(rules_sql("packet_a", _PATTERN)))
def val_patterns(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("packet_a"), an.pattern_rules())


@query("val_text", o.with_ctes(rules_sql("packet_a", _TEXT)))
def val_text(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("packet_a"), an.text_rules())


@query("val_domains", o.with_ctes(rules_sql("master", _MASTER)))
def val_domains(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("master"), an.master_domain_rules())


@query("val_blind_domains", o.with_ctes(rules_sql("packet_a", _BLIND)))
def val_blind_domains(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("packet_a"), an.blind_domain_rules())


@query("val_taxonomy", o.with_ctes(rules_sql("packet_a", _TAXONOMY)))
def val_taxonomy(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("packet_a"), an.taxonomy_rules())


@query("val_uncertainty", o.with_ctes(rules_sql("packet_a", _UNCERTAIN)))
def val_uncertainty(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("packet_a"), an.uncertainty_rules())


@query("val_created_at", o.with_ctes(rules_sql("master", _CREATED)))
def val_created_at(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("master"), an.created_at_rules())


@query("utc_timestamp_check", o.with_ctes("SELECT created_at, ends_with(created_at, 'Z') AND try_cast(created_at[:-2] AS TIMESTAMP) IS NOT NULL AS is_utc, count(*) AS n FROM master GROUP BY 1"))
def utc_timestamp_check(t: Tables) -> DataFrame:
    rows = t.derived("master").select("created_at", an.is_utc_timestamp(F.col("created_at")).alias("is_utc"))
    return rows.groupBy("created_at", "is_utc").agg(F.count(F.lit(1)).alias("n"))


@query("val_status_machine", o.with_ctes(rules_sql("master", _STATUS)))
def val_status_machine(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("master"), an.status_rules())


@query("val_split_rules", o.with_ctes(rules_sql("master", _SPLIT)))
def val_split_rules(t: Tables) -> DataFrame:
    return an.row_violations(t.derived("master"), an.split_rules())


@query("val_family_leak", o.with_ctes(_FAMILIES))
def val_family_leak(t: Tables) -> DataFrame:
    return an.family_leaks(t.derived("master"))


_ALL_BLIND = rules_sql("packet_a", {**_PATTERN, **_TEXT, **_BLIND, **_TAXONOMY, **_UNCERTAIN}) + " UNION ALL " + _IDS
_ALL_MASTER = rules_sql("master", {**_PATTERN, **_TEXT, **_MASTER, **_CREATED, **_TAXONOMY, **_STATUS, **_SPLIT}) + " UNION ALL " + _MASTER_IDS


@query("validate_table_blind", o.with_ctes(f"SELECT concat('row ', row_number) AS subject, rule FROM ({_ALL_BLIND})"))
def validate_table_blind(t: Tables) -> DataFrame:
    return an.validate(t.derived("packet_a"), "blind")


@query("validate_table", o.with_ctes(f"SELECT concat('row ', row_number) AS subject, rule FROM ({_ALL_MASTER}) UNION ALL SELECT concat('family ', family_id), 'family_spans_splits' FROM ({_FAMILIES})"))
def validate_table(t: Tables) -> DataFrame:
    return an.validate(t.derived("master"), "master")


_PAIR_FINDINGS = " UNION ALL ".join(
    f"SELECT 'packet_{n}' AS step, concat('row ', row_number) AS subject, rule AS problem FROM ({_ALL_BLIND.replace('packet_a', f'packet_{n}')})" for n in "ab")


@query("packet_pair_findings", o.with_ctes(_PAIR_FINDINGS))
def packet_pair_findings(t: Tables) -> DataFrame:
    """Both packets are validated before they are compared; these two have findings."""
    return an.check_pair(t.derived("packet_a"), t.derived("packet_b"))


# --- two annotators ---------------------------------------------------------------------------

_DIFF = ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in C.PACKET_SHARED_FIELDS)


@query("packet_pair_check", o.with_ctes(f"""SELECT case_id, problem, CASE WHEN problem = 'fields_differ' THEN fields END AS fields FROM (
    SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN b.case_id IS NULL THEN 'missing_from_b' WHEN a.case_id IS NULL THEN 'additional_in_b' WHEN concat_ws('|', {_DIFF}) <> '' THEN 'fields_differ' END AS problem,
    concat_ws('|', {_DIFF}) AS fields FROM packet_a_clean a FULL JOIN packet_b b ON a.case_id = b.case_id) WHERE problem IS NOT NULL"""))
def packet_pair_check(t: Tables) -> DataFrame:
    return joins.compare_packets(t.derived("packet_a_clean"), t.derived("packet_b"))


o.define("pairs", """SELECT case_id, a.annotator_label AS label_a, b.annotator_label AS label_b, a.sentiment_subgroup AS subgroup FROM packet_a_clean a JOIN packet_b b USING (case_id)
    WHERE a.annotator_label <> '' AND b.annotator_label <> ''""")


def pairs(t: Tables) -> DataFrame:
    return an.label_pairs(t.derived("packet_a_clean"), t.derived("packet_b"))


@query("label_overlap", o.with_ctes("SELECT case_id, label_a, label_b FROM pairs"))
def label_overlap(t: Tables) -> DataFrame:
    return pairs(t)


def _kappa(group: str | None) -> str:
    g, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    key = f"p.{group} = q.{group} AND " if group else ""
    return f"""SELECT {g}completed_overlap, round(po, 6) AS raw_agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) WHEN po = 1 THEN 1.0::DOUBLE END, 6) AS cohen_kappa FROM (
      SELECT {g}count(*) AS completed_overlap, avg((label_a = label_b)::INT) AS po,
        (SELECT sum(ca * cb)::DOUBLE FROM (SELECT l, (SELECT count(*) FROM pairs p WHERE {key}p.label_a = l) AS ca, (SELECT count(*) FROM pairs p WHERE {key}p.label_b = l) AS cb
          FROM (SELECT unnest([{o.words(C.ANNOTATION_LABELS)}]) AS l))) / (count(*) * count(*)) AS pe FROM pairs q{by})"""


@query("agreement", o.with_ctes(_kappa(None)))
def agreement(t: Tables) -> DataFrame:
    return an.agreement(pairs(t))


o.define("pair_counts", "SELECT subgroup, label_a, label_b, count(*) AS n FROM pairs GROUP BY 1, 2, 3")


@query("agreement_by_subgroup", o.with_ctes("""SELECT subgroup, n AS completed_overlap, round(po, 6) AS raw_agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) WHEN po = 1 THEN 1.0::DOUBLE END, 6) AS cohen_kappa FROM (
    SELECT t.subgroup, t.n, t.hit / t.n AS po, e.s / (t.n * t.n) AS pe FROM (SELECT subgroup, sum(n)::DOUBLE AS n_, sum(n)::BIGINT AS n, sum(n) FILTER (label_a = label_b)::DOUBLE AS hit FROM pair_counts GROUP BY 1) t
    JOIN (SELECT a.subgroup, sum(a.c * b.c)::DOUBLE AS s FROM (SELECT subgroup, label_a AS l, sum(n) AS c FROM pair_counts GROUP BY 1, 2) a
      JOIN (SELECT subgroup, label_b AS l, sum(n) AS c FROM pair_counts GROUP BY 1, 2) b ON a.subgroup = b.subgroup AND a.l = b.l GROUP BY 1) e USING (subgroup))"""))
def agreement_by_subgroup(t: Tables) -> DataFrame:
    groups = t.derived("packet_a_clean").select("case_id", F.col("sentiment_subgroup").alias("subgroup"))
    return an.agreement(pairs(t).join(groups, "case_id"), ["subgroup"])


@query("agreement_matrix", o.with_ctes(f"""SELECT a.l AS label_a, b.l AS label_b, (SELECT count(*) FROM pairs p WHERE p.label_a = a.l AND p.label_b = b.l) AS n
    FROM (SELECT unnest([{o.words(C.ANNOTATION_LABELS)}]) AS l) a, (SELECT unnest([{o.words(C.ANNOTATION_LABELS)}]) AS l) b"""))
def agreement_matrix(t: Tables) -> DataFrame:
    return an.agreement_matrix(pairs(t))


@query("agreement_prevalence", o.with_ctes(" UNION ALL ".join(
    f"SELECT 'annotator_{who}' AS annotator, l AS label, (SELECT count(*) FROM pairs p WHERE p.label_{who.lower()} = l) AS n FROM (SELECT unnest([{o.words(C.ANNOTATION_LABELS)}]) AS l)"
    for who in "AB")))
def agreement_prevalence(t: Tables) -> DataFrame:
    return an.prevalence(pairs(t))


@query("agreement_disagreements", o.with_ctes("SELECT case_id, label_a, label_b FROM pairs WHERE label_a <> label_b"))
def agreement_disagreements(t: Tables) -> DataFrame:
    return pairs(t).filter("label_a <> label_b")
