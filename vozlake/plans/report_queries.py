"""Queries over report facts, eligibility, selections and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.operators import metrics as mt
from vozlake.operators import report, scoring, selection
from vozlake.plans import inputs
from vozlake.plans import oracle as o
from vozlake.plans.registry import Tables, query
from vozlake.plans.text_queries import comments

BATCH = ["source"]


def tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    return report.batch_tables(scoring.score(comments(t)), BATCH)


def registry_of(t: Tables) -> DataFrame:
    """Facts of every batch, stored: lineage, eligibility and payloads read them several times."""
    metrics, pareto = tables(t)
    return cut(report.facts(metrics, pareto, BATCH), "facts")


_FACT = "SELECT source, '{id}' AS fact_id, ({v})::DOUBLE AS value_num, {text} AS value_text, {num} AS numerator_fact, {den} AS denominator_fact FROM {table}"


def _fact(name: str, value: str, num: str = "NULL", den: str = "NULL", text: str = "NULL::VARCHAR", table: str = "bm_metrics") -> str:
    return _FACT.format(id=name, v=value, num=num, den=den, text=text, table=table)


o.define("lex", "SELECT m.source, coalesce(sum(p.frequency), 0)::BIGINT AS fsum, count(*) FILTER (p.within_80_percent) AS block FROM bm_metrics m LEFT JOIN st_pareto p USING (source) GROUP BY 1")
_FACTS = [_fact("dataset.total_comments", "total")]
for _s in C.CLASS_SLUGS.values():
    _FACTS += [_fact(f"sentiment.{_s}.count", f"{_s}_count"),
               _fact(f"sentiment.{_s}.share", f"{_s}_percentage", f"'sentiment.{_s}.count'", "'dataset.total_comments'")]
_FACTS += [
    _fact("sentiment.positive_negative_ratio", "CASE WHEN negative_count > 0 OR positive_count = 0 THEN positive_negative_ratio END", "'sentiment.positive.count'", "'sentiment.negative.count'",
          "CASE WHEN negative_count = 0 AND positive_count > 0 THEN 'undefined_no_negative_comments' END"),
    _fact("model.mean_local_confidence", "mean_confidence"), _fact("technical.high_confidence_negative.threshold", "round(critical_confidence_threshold, 6)"),
    _fact("technical.high_confidence_negative.count", "critical_negative_count"),
    _fact("lexical.selected_frequency_sum", "fsum", table="lex"), _fact("lexical.pareto_block_term_count", "block", table="lex"),
    "SELECT source, concat('lexical.rank.', rank, '.frequency'), frequency::DOUBLE, NULL, NULL, NULL FROM st_pareto",
    "SELECT source, concat('lexical.rank.', rank, '.share'), percentage, NULL, concat('lexical.rank.', rank, '.frequency'), 'lexical.selected_frequency_sum' FROM st_pareto",
    "SELECT source, concat('lexical.rank.', rank, '.cumulative_share'), cumulative_percentage, NULL, NULL, 'lexical.selected_frequency_sum' FROM st_pareto",
]
o.define("fact_rows", " UNION ALL ".join(_FACTS))


@query("report_facts", o.with_ctes("SELECT source, fact_id, value_num, value_text, numerator_fact, denominator_fact FROM fact_rows"))
def report_facts(t: Tables) -> DataFrame:
    return registry_of(t).select("source", "fact_id", "value_num", "value_text", "numerator_fact", "denominator_fact")


@query("fact_lineage_check", o.with_ctes("""SELECT f.source, f.fact_id, true AS links_exist, true AS value_follows FROM fact_rows f WHERE numerator_fact IS NOT NULL AND denominator_fact IS NOT NULL"""))
def fact_lineage_check(t: Tables) -> DataFrame:
    return report.lineage(registry_of(t), BATCH)


o.define("eligible_rows", " UNION ALL ".join(
    f"SELECT source, '{kind}' AS kind, '{name}' AS id FROM " + (
        "bm_metrics" if rule in ("always", "absent") else f"(SELECT source, value_num AS v FROM fact_rows WHERE fact_id = '{fact}') WHERE v {'> 0' if rule == 'positive' else '= 0'}")
    for kind, name, fact, rule in C.ELIGIBILITY_RULES))


@query("eligible_ids", o.with_ctes("SELECT source, kind, id FROM eligible_rows"))
def eligible_ids(t: Tables) -> DataFrame:
    return report.eligible(registry_of(t), BATCH)


@query("batch_capabilities", o.with_ctes(f"SELECT source, unnest([{o.words(C.CAPABILITIES)}]) AS capability, false AS available FROM bm_metrics"))
def batch_capabilities(t: Tables) -> DataFrame:
    """Capability flags of every batch: these tables have no periods, targets or categories."""
    return report.capabilities(registry_of(t), BATCH)


o.define("broken_facts", """SELECT * REPLACE (CASE WHEN fact_id = 'sentiment.positive.share' THEN value_num + 1 ELSE value_num END AS value_num) FROM fact_rows
    WHERE NOT (fact_id = 'lexical.rank.1.frequency') AND NOT (fact_id = 'dataset.total_comments' AND source LIKE '%1')""")


@query("fact_lineage_faults", o.with_ctes("""SELECT f.source, f.fact_id, n.fact_id IS NOT NULL AND d.fact_id IS NOT NULL AS links_exist,
    coalesce(abs(f.value_num - n.value_num * CASE WHEN f.fact_id LIKE '%share' THEN 100 ELSE 1 END / nullif(d.value_num, 0)) < 1e-5, f.value_num IS NULL OR d.value_num = 0, false) AS value_follows
    FROM broken_facts f LEFT JOIN broken_facts n ON n.source = f.source AND n.fact_id = f.numerator_fact LEFT JOIN broken_facts d ON d.source = f.source AND d.fact_id = f.denominator_fact
    WHERE f.numerator_fact IS NOT NULL AND f.denominator_fact IS NOT NULL"""))
def fact_lineage_faults(t: Tables) -> DataFrame:
    """The lineage check on facts of which some are gone and one value is off."""
    gone = (F.col("fact_id") == "lexical.rank.1.frequency") | ((F.col("fact_id") == "dataset.total_comments") & F.col("source").endswith("1"))
    moved = F.when(F.col("fact_id") == "sentiment.positive.share", F.col("value_num") + 1).otherwise(F.col("value_num"))
    return report.lineage(registry_of(t).filter(~gone).withColumn("value_num", moved), BATCH)


@query("opportunity_band", o.with_ctes("SELECT source, negative_percentage, CASE WHEN negative_percentage >= 40 THEN 'high' WHEN negative_percentage >= 20 THEN 'relevant' ELSE 'contained' END AS band FROM bm_metrics"))
def opportunity_band(t: Tables) -> DataFrame:
    metrics = mt.sentiment_metrics(scoring.score(comments(t)), BATCH)
    return metrics.select("source", "negative_percentage", report.opportunity_band(F.col("negative_percentage")).alias("band"))


def _pct(expr: str, digits: int = 2) -> str:
    return f"round({expr}, {digits})::DECIMAL(18, {digits})::VARCHAR"


o.define("line_rows", f"""SELECT source, 'summary' AS section, 1 AS line_no, concat('Comentarios analizados: ', total) AS line FROM bm_metrics
  UNION ALL SELECT source, 'summary', 2, concat('Confianza media: ', {_pct('mean_confidence', 4)}) FROM bm_metrics
  UNION ALL SELECT source, 'distribution', 1, concat('Positivos: ', positive_count, ' (', {_pct('positive_percentage')}, ' %)') FROM bm_metrics
  UNION ALL SELECT source, 'distribution', 2, concat('Neutros: ', neutral_count, ' (', {_pct('neutral_percentage')}, ' %)') FROM bm_metrics
  UNION ALL SELECT source, 'distribution', 3, concat('Negativos: ', negative_count, ' (', {_pct('negative_percentage')}, ' %)') FROM bm_metrics
  UNION ALL SELECT source, 'distribution', 4, concat('Positivos por negativo: ', CASE WHEN negative_count = 0 AND positive_count > 0 THEN 'sin negativos' ELSE {_pct('CASE WHEN negative_count > 0 THEN positive_negative_ratio ELSE 0 END')} END) FROM bm_metrics
  UNION ALL SELECT source, 'pareto', 1, CASE WHEN block > 0 THEN concat('Términos del bloque: ', block) ELSE 'Sin términos negativos' END FROM lex
  UNION ALL SELECT source, 'opportunity', 1, CASE WHEN negative_percentage >= 40 THEN 'Revise los términos frecuentes y una muestra amplia de comentarios negativos.'
      WHEN negative_percentage >= 20 THEN 'Revise los términos dominantes y valide sus grupos a mano.' ELSE 'Revise una muestra de los comentarios negativos.' END FROM bm_metrics
  UNION ALL SELECT source, 'limits', 1, 'Los términos son n-gramas y la confianza no mide acierto.' FROM bm_metrics
  UNION ALL SELECT source, 'topics', rank, concat(topic, ': ', frequency, ' menciones') FROM st_pareto WHERE rank <= 3""")


@query("batch_report_lines", o.with_ctes("SELECT source, section, line_no, line FROM line_rows"))
def batch_report_lines(t: Tables) -> DataFrame:
    return report.report_lines(*tables(t), BATCH)


@query("dashboard_view", o.with_ctes("""SELECT m.source, total, positive_count, positive_percentage, negative_count, negative_percentage, mean_confidence, critical_negative_count, critical_confidence_threshold,
    CASE WHEN negative_count > 0 OR positive_count = 0 THEN positive_negative_ratio END AS ratio, block AS priority_topic_count,
    coalesce((SELECT string_agg(concat(rank, ':', topic, '=', frequency), '|' ORDER BY rank) FROM st_pareto p WHERE p.source = m.source AND rank <= 3), '') AS topics
    FROM bm_metrics m JOIN lex USING (source)"""))
def dashboard_view(t: Tables) -> DataFrame:
    return report.dashboard(*tables(t), BATCH)


@query("evidence_payload")
def evidence_payload(t: Tables) -> DataFrame:
    """Serialised JSON differs between engines in layout, so rows only; see the tests."""
    return report.evidence_payload(registry_of(t), BATCH)


_DISPLAY = """CASE WHEN fact_id LIKE '%share' THEN round(value_num, 2) WHEN fact_id LIKE '%ratio' THEN round(value_num, 6)
    WHEN fact_id IN ('model.mean_local_confidence', 'technical.high_confidence_negative.threshold') THEN round(value_num, 4) ELSE value_num END"""


@query("evidence_rows", o.with_ctes(f"""SELECT source, 'fact' AS part, fact_id AS name, {_DISPLAY} AS value, concat(coalesce(value_text, ''), '|', coalesce(numerator_fact, ''), '|', coalesce(denominator_fact, '')) AS text FROM fact_rows
    UNION ALL SELECT source, kind, id, NULL, NULL FROM eligible_rows
    UNION ALL SELECT source, 'schema_version', '{C.READING_SCHEMA_VERSION}', NULL, NULL FROM bm_metrics
    UNION ALL SELECT source, 'capability', unnest([{o.words(C.CAPABILITIES)}]), 0, NULL FROM bm_metrics
    UNION ALL SELECT b.source, 'limit', l.n, l.v, NULL FROM bm_metrics b, (VALUES {', '.join(f"('{k}', {v})" for k, v in C.READING_LIMITS.items())}) l(n, v)"""))
def evidence_rows(t: Tables) -> DataFrame:
    """The evidence payload of every batch, read back from its JSON."""
    return report.read_payload(report.evidence_payload(registry_of(t), BATCH), BATCH)


@query("payload_size")
def payload_size(t: Tables) -> DataFrame:
    sized = report.evidence_payload(registry_of(t), BATCH)
    return sized.select("source", F.inline(F.array(report.payload_size(F.col("payload")))))


# --- submitted selections -----------------------------------------------------------------------

_GOOD_I = '{{"interpretation_id":"confidence_requires_independent_evaluation","fact_refs":["model.mean_local_confidence"]}}'
_NEG_I = '{{"interpretation_id":"review_negative_distribution","fact_refs":["sentiment.negative.count","sentiment.negative.share"]}}'
_GOOD_H = '{{"hypothesis_id":"negative_predictions_may_include_model_errors","fact_refs":["sentiment.negative.count"],"validation_needed_id":"qualitative_comment_review"}}'


def _root(i: str = "", h: str = "", r: str = "", e: str = "", n: str = "", version: str = '"2.0"', extra: str = "") -> str:
    return (f'{{{{"schema_version":{version},"interpretations":[{i}],"hypotheses":[{h}],"recommendation_ids":[{r}],'
            f'"evidence_needed_ids":[{e}],"insufficient_evidence_ids":[{n}]{extra}}}}}')


# what a submitter may send, good and broken in every way the contract names
SUBMITTED = (
    _root(), _root(_GOOD_I), _root(_NEG_I, _GOOD_H, '"review_negative_sample"', '"temporal_baseline"', '"no_time_comparison"'),
    "not json", "[1,2]", _root(extra=',"note":1'), _root(version='"1.0"'), _root(version="2.0"),
    _root(",".join([_GOOD_I] * 4)), _root(f"{_GOOD_I},{_GOOD_I}"), _root('{{"interpretation_id":"confidence_requires_independent_evaluation"}}'),
    _root('{{"interpretation_id":"made_up","fact_refs":[]}}'), _root(_GOOD_I.replace('["model.mean_local_confidence"]', '[]')),
    _root(_GOOD_I.replace('["model.mean_local_confidence"]', '["model.mean_local_confidence","model.mean_local_confidence"]')),
    _root(_GOOD_I.replace("model.mean_local_confidence", "no.such.fact")), _root(_GOOD_I.replace("model.mean_local_confidence", "dataset.total_comments")),
    _root(_GOOD_I.replace('["model.mean_local_confidence"]', '"model.mean_local_confidence"')), _root(_GOOD_I.replace('["model.mean_local_confidence"]', '[5]')),
    _root(h=_GOOD_H.replace("negative_predictions_may_include_model_errors", "other")), _root(h=_GOOD_H.replace('"qualitative_comment_review"', "7")),
    _root(h=_GOOD_H.replace("qualitative_comment_review", "business_objectives")), _root(h=f"{_GOOD_H},{_GOOD_H}"),
    _root(h=_GOOD_H.replace("sentiment.negative.count", "sentiment.negative.share")), _root(h='{{"hypothesis_id":"x"}}'),
    _root(r='"define_business_objectives","define_business_objectives"'), _root(r='"sell_more"'), _root(r="1"),
    _root(e='"crystal_ball"'), _root(e='"temporal_baseline","temporal_baseline"'), _root(n='"no_negative_comments"'), _root(n='"no_lexical_terms"'),
    _root(r='"collect_temporal_baseline","define_business_objectives","independent_model_evaluation","review_negative_sample"'),
    _root().replace('"hypotheses":[]', '"hypotheses":{{}}'), _root(n='"no_business_targets","no_business_targets"'),
)
SELECTIONS = (
    "SELECT event_id, concat('src', CAST(user_id % 20 AS STRING)) AS source, CASE event_id % " + str(len(SUBMITTED)) + " "
    + " ".join(f"WHEN {k} THEN '{raw}'" for k, raw in enumerate(SUBMITTED)) + " END AS raw FROM {events}")
inputs.DERIVED["selections"] = SELECTIONS
o.define("selections", inputs.duckdb_text("selections"))


def _list(values) -> str:
    return f"[{o.words(values)}]"


def _by_name(table: dict, name: str) -> str:
    return "CASE " + name + " " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in table.items()) + " ELSE [] END"


_STR = "json_extract_string({it}, '$.{f}')"


def _refs_sql(allowed: str, wrong: str) -> str:
    refs = "json_extract_string(it, '$.fact_refs[*]')"
    return f"""WHEN coalesce(json_type(it, '$.fact_refs'), '') <> 'ARRAY' OR json_array_length(it, '$.fact_refs') > 4 OR len(list_filter(json_extract(it, '$.fact_refs[*]'), lambda y: json_type(y) <> 'VARCHAR')) > 0 THEN 'invalid_fact_refs'
      WHEN len(list_distinct({refs})) < len({refs}) THEN 'duplicate_fact_ref' WHEN len(list_filter({refs}, lambda y: NOT list_contains(known, y))) > 0 THEN 'unknown_fact_ref'
      WHEN len({refs}) = 0 OR len(list_filter({refs}, lambda y: NOT list_contains({allowed}, y))) > 0 THEN '{wrong}'"""


def _keys(value: str, *names: str) -> str:
    return f"(json_type({value}) = 'OBJECT' AND list_sort(json_keys({value})) = {_list(sorted(names))})"


_I_ID, _H_ID = "json_extract_string(it, '$.interpretation_id')", "json_extract_string(it, '$.hypothesis_id')"
_I_CODE = f"""CASE WHEN NOT {_keys('it', 'interpretation_id', 'fact_refs')} THEN 'invalid_interpretation_fields' WHEN NOT list_contains(a_interpretation, {_I_ID}) THEN 'ineligible_interpretation'
  {_refs_sql(_by_name(C.INTERPRETATION_FACTS, _I_ID), 'invalid_interpretation_fact_refs')} END"""
_H_CODE = f"""CASE WHEN NOT {_keys('it', 'hypothesis_id', 'fact_refs', 'validation_needed_id')} THEN 'invalid_hypothesis_fields' WHEN NOT list_contains(a_hypothesis, {_H_ID}) THEN 'ineligible_hypothesis'
  WHEN json_type(it, '$.validation_needed_id') <> 'VARCHAR' THEN 'invalid_validation_needed_id' {_refs_sql(_by_name(C.HYPOTHESIS_FACTS, _H_ID), 'invalid_hypothesis_fact_refs')}
  WHEN NOT list_contains({_by_name(C.HYPOTHESIS_VALIDATIONS, _H_ID)}, json_extract_string(it, '$.validation_needed_id')) THEN 'ineligible_hypothesis_validation' END"""


def _items_sql(field: str, limit: int, code: str, id_field: str, duplicate: str) -> str:
    ids = f"json_extract_string(j, '$.{field}[*].{id_field}')"
    return f"""WHEN coalesce(json_type(j, '$.{field}'), '') <> 'ARRAY' OR json_array_length(j, '$.{field}') > {limit} THEN 'invalid_{field}'
      WHEN len(list_filter(list_transform(json_extract(j, '$.{field}[*]'), lambda it: {code}), lambda c: c IS NOT NULL)) > 0 THEN list_filter(list_transform(json_extract(j, '$.{field}[*]'), lambda it: {code}), lambda c: c IS NOT NULL)[1]
      WHEN len(list_distinct({ids})) < len({ids}) THEN '{duplicate}'"""


def _ids_sql(field: str, allowed: str) -> str:
    values, single = f"json_extract_string(j, '$.{field}[*]')", field.removesuffix("_ids")
    return f"""WHEN coalesce(json_type(j, '$.{field}'), '') <> 'ARRAY' OR json_array_length(j, '$.{field}') > {C.READING_LIMITS[field]} OR len(list_filter(json_extract(j, '$.{field}[*]'), lambda y: json_type(y) <> 'VARCHAR')) > 0 THEN 'invalid_{field}'
      WHEN len(list_distinct({values})) < len({values}) THEN 'duplicate_{single}' WHEN len(list_filter({values}, lambda y: NOT list_contains({allowed}, y))) > 0 THEN 'ineligible_{single}'"""


o.define("allowed_lists", """SELECT source, list(id) FILTER (kind = 'interpretation') AS a_interpretation, coalesce(list(id) FILTER (kind = 'hypothesis'), []) AS a_hypothesis, list(id) FILTER (kind = 'recommendation') AS a_recommendation,
    list(id) FILTER (kind = 'insufficient') AS a_insufficient, any_value(known) AS known FROM eligible_rows JOIN (SELECT source, list(fact_id) AS known FROM fact_rows GROUP BY 1) USING (source) GROUP BY 1""")
# codes depend only on (batch, raw), so distinct pairs are judged once
o.define("judged", f"""SELECT source, raw, CASE WHEN j IS NULL THEN 'invalid_json' WHEN json_type(j) <> 'OBJECT' THEN 'invalid_root_type' WHEN list_sort(json_keys(j)) <> {_list(sorted(selection.ROOT_KEYS))} THEN 'invalid_root_fields'
    WHEN json_type(j, '$.schema_version') <> 'VARCHAR' OR json_extract_string(j, '$.schema_version') <> '2.0' THEN 'invalid_schema_version'
    {_items_sql('interpretations', 3, _I_CODE, 'interpretation_id', 'duplicate_interpretation')} {_items_sql('hypotheses', 2, _H_CODE, 'hypothesis_id', 'duplicate_hypothesis')}
    {_ids_sql('recommendation_ids', 'a_recommendation')} {_ids_sql('evidence_needed_ids', _list(C.EVIDENCE_NEEDED_IDS))} {_ids_sql('insufficient_evidence_ids', 'a_insufficient')} END AS error_code
    FROM (SELECT DISTINCT source, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM selections) JOIN allowed_lists USING (source)""")


@query("selection_audit", o.with_ctes("SELECT event_id, s.source, error_code FROM selections s JOIN judged USING (source, raw)"))
def selection_audit(t: Tables) -> DataFrame:
    allowed = report.eligible_arrays(registry_of(t), BATCH)
    return selection.audit(t.derived("selections"), allowed, BATCH).select("event_id", "source", "error_code")


@query("selection_codes", o.with_ctes("SELECT coalesce(error_code, 'accepted') AS code, count(*) AS n FROM selections JOIN judged USING (source, raw) GROUP BY 1"))
def selection_codes(t: Tables) -> DataFrame:
    code = F.coalesce("error_code", F.lit("accepted")).alias("code")
    return selection_audit(t).groupBy(code).agg(F.count(F.lit(1)).alias("n"))


@query("catalog_check", o.with_ctes("""SELECT event_id, source, kind, id FROM (
    SELECT event_id, source, 'recommendation' AS kind, unnest(json_extract_string(raw, '$.recommendation_ids[*]')) AS id FROM selections WHERE json_valid(raw) UNION ALL
    SELECT event_id, source, 'insufficient', unnest(json_extract_string(raw, '$.insufficient_evidence_ids[*]')) FROM selections WHERE json_valid(raw))
    WHERE (source, kind, id) NOT IN (SELECT (source, kind, id) FROM eligible_rows)"""))
def catalog_check(t: Tables) -> DataFrame:
    return selection.unknown_ids(t.derived("selections"), report.eligible(registry_of(t), BATCH), BATCH, "event_id")


def _string_of(value: str, path: str) -> str:
    return f"CASE WHEN json_type({value}, '{path}') = 'VARCHAR' THEN json_extract_string({value}, '{path}') END"


def _entries_sql(kind: str, field: str, refs: dict) -> str:
    return f"""SELECT event_id, source, '{kind}' AS kind, it, id, a_{kind} AS catalog, {_by_name(refs, 'id')} AS refs, known FROM (SELECT *, {_string_of('it', f'$.{kind}_id')} AS id
      FROM (SELECT event_id, source, unnest(json_extract(raw::JSON, '$.{field}[*]')) AS it FROM selections WHERE json_valid(raw))) LEFT JOIN allowed_lists USING (source)"""


def _plain_sql(kind: str, field: str, catalog: str) -> str:
    return f"""SELECT event_id, source, '{kind}', id, NULL, 'ineligible_id' FROM (SELECT event_id, source, {_string_of('v', '$')} AS id
      FROM (SELECT event_id, source, unnest(json_extract(raw::JSON, '$.{field}[*]')) AS v FROM selections WHERE json_valid(raw))) LEFT JOIN allowed_lists USING (source) WHERE NOT coalesce(list_contains({catalog}, id), false)"""


o.define("selected_entries", _entries_sql("interpretation", "interpretations", C.INTERPRETATION_FACTS) + " UNION ALL " + _entries_sql("hypothesis", "hypotheses", C.HYPOTHESIS_FACTS))
o.define("selected_refs", f"""SELECT * REPLACE ({_string_of('r', '$')} AS r) FROM (SELECT event_id, source, kind, id, refs, known, unnest(json_extract(it, '$.fact_refs[*]')) AS r FROM selected_entries)""")


@query("catalog_check_all", o.with_ctes(f"""SELECT event_id, source, kind, id, NULL::VARCHAR AS ref, 'ineligible_id' AS rule FROM selected_entries WHERE NOT coalesce(list_contains(catalog, id), false)
    UNION ALL SELECT event_id, source, kind, id, r, CASE WHEN coalesce(list_contains(known, r), false) THEN 'ref_not_allowed' ELSE 'unknown_fact' END FROM selected_refs
      WHERE NOT (coalesce(list_contains(known, r), false) AND coalesce(list_contains(refs, r), false))
    UNION ALL SELECT event_id, source, kind, id, NULL, 'without_refs' FROM selected_entries WHERE coalesce(json_type(it, '$.fact_refs'), '') <> 'ARRAY' OR json_array_length(it, '$.fact_refs') = 0
    UNION ALL SELECT event_id, source, kind, id, v, 'validation_not_allowed' FROM (SELECT *, {_string_of('it', '$.validation_needed_id')} AS v FROM selected_entries WHERE kind = 'hypothesis')
      WHERE NOT coalesce(list_contains({_by_name(C.HYPOTHESIS_VALIDATIONS, 'id')}, v), false)
    UNION ALL {_plain_sql('recommendation', 'recommendation_ids', 'a_recommendation')} UNION ALL {_plain_sql('evidence', 'evidence_needed_ids', _list(C.EVIDENCE_NEEDED_IDS))}
    UNION ALL {_plain_sql('insufficient', 'insufficient_evidence_ids', 'a_insufficient')}"""))
def catalog_check_all(t: Tables) -> DataFrame:
    """Ids of every list, fact references and validations that the catalog or the facts of their batch don't allow."""
    return selection.catalog_violations(t.derived("selections"), report.eligible_arrays(registry_of(t), BATCH), BATCH, "event_id")
