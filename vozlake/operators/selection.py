"""Audit of submitted reading selections against the facts of their batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.functions.text import let

ROOT_KEYS = ("schema_version", "interpretations", "hypotheses", "recommendation_ids", "evidence_needed_ids", "insufficient_evidence_ids")


def _members(value: Column) -> Column:
    """Members of a JSON object, null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(doc: Column, field: str) -> Column:
    """array<variant> of a list field, null when the field is not a list."""
    return F.try_variant_get(doc, f"$.{field}", "array<variant>")


def _keys(item: Column, *names: str) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(_members(item))) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def _is_text(value: Column) -> Column:
    """A number reads as text as well, so the JSON form decides."""
    return F.to_json(value).startswith('"')


def _text(item: Column, path: str) -> Column:
    """String value at ``path``; null when it is not a JSON string."""
    return F.when(_is_text(F.try_variant_get(item, path, "variant")), F.try_variant_get(item, path, "string"))


def _strings(values: Column) -> Column:
    """array<string> with null for entries that are not strings."""
    return F.transform(values, lambda v: F.when(_is_text(v), F.try_variant_get(v, "$", "string")))


def _allowed(table: dict[str, Sequence[str]], name: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(name, F.lit("")))


def _missing_from(values: Column, allowed: Column) -> Column:
    return F.size(F.array_except(values, F.array_compact(allowed))) > 0


def _ref_code(item: Column, known: Column) -> Column:
    """First failing rule of an item's fact references, null when sound."""
    refs = _items(item, "fact_refs")

    def check(values: Column) -> Column:
        broken = values.isNull() | (F.size(values) > C.READING_LIMITS["fact_refs"]) | F.exists(values, lambda v: v.isNull())
        return (
            F.when(F.coalesce(broken, F.lit(True)), "invalid_fact_refs")
            .when(F.size(F.array_distinct(values)) < F.size(values), "duplicate_fact_ref")
            .when(_missing_from(values, known), "unknown_fact_ref")
        )

    return let(F.when(refs.isNotNull(), _strings(refs)), check)


def _refs_outside(item: Column, allowed: Column) -> Column:
    values = _strings(_items(item, "fact_refs"))
    return (F.size(values) == 0) | _missing_from(values, allowed)


def _first(codes: Column) -> Column:
    return F.get(F.array_compact(codes), F.lit(0))


def _list_code(doc: Column, field: str, limit: int, broken: str, item_code, duplicate: str, id_field: str) -> Column:
    items = _items(doc, field)

    def check(values: Column) -> Column:
        ids = F.transform(values, lambda v: _text(v, f"$.{id_field}"))
        return (
            F.when(F.coalesce(values.isNull() | (F.size(values) > limit), F.lit(True)), broken)
            .otherwise(F.coalesce(
                _first(F.transform(values, item_code)),
                F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit(duplicate))))
        )

    return let(items, check)


def _ids_code(doc: Column, field: str, allowed: Column) -> Column:
    single = field.removesuffix("_ids")

    def check(values: Column) -> Column:
        broken = values.isNull() | (F.size(values) > C.READING_LIMITS[field]) | F.exists(values, lambda v: v.isNull())
        return (
            F.when(F.coalesce(broken, F.lit(True)), f"invalid_{field}")
            .when(F.size(F.array_distinct(values)) < F.size(values), f"duplicate_{single}")
            .when(_missing_from(values, allowed), f"ineligible_{single}")
        )

    items = _items(doc, field)
    return let(F.when(items.isNotNull(), _strings(items)), check)


def audit_code(raw: Column) -> Column:
    """First failing contract code; needs the ``eligible_arrays`` columns beside."""
    known = F.col("known_facts")

    def interpretation(item: Column) -> Column:
        name = _text(item, "$.interpretation_id")
        return (
            F.when(~_keys(item, "interpretation_id", "fact_refs"), "invalid_interpretation_fields")
            .when(~F.coalesce(F.array_contains(F.array_compact("allowed_interpretation"), name), F.lit(False)), "ineligible_interpretation")
            .otherwise(F.coalesce(_ref_code(item, known), F.when(
                _refs_outside(item, _allowed(C.INTERPRETATION_FACTS, name)), F.lit("invalid_interpretation_fact_refs"))))
        )

    def hypothesis(item: Column) -> Column:
        name, check = _text(item, "$.hypothesis_id"), _text(item, "$.validation_needed_id")
        return (
            F.when(~_keys(item, "hypothesis_id", "fact_refs", "validation_needed_id"), "invalid_hypothesis_fields")
            .when(~F.coalesce(F.array_contains(F.array_compact("allowed_hypothesis"), name), F.lit(False)), "ineligible_hypothesis")
            .when(check.isNull(), "invalid_validation_needed_id")
            .otherwise(F.coalesce(
                _ref_code(item, known),
                F.when(_refs_outside(item, _allowed(C.HYPOTHESIS_FACTS, name)), F.lit("invalid_hypothesis_fact_refs")),
                F.when(~F.array_contains(_allowed(C.HYPOTHESIS_VALIDATIONS, name), check), F.lit("ineligible_hypothesis_validation"))))
        )

    def check(doc: Column) -> Column:
        return (
            F.when(doc.isNull(), "invalid_json")
            .when(_members(doc).isNull(), "invalid_root_type")
            .when(~_keys(doc, *ROOT_KEYS), "invalid_root_fields")
            .when(~F.coalesce(_text(doc, "$.schema_version") == C.READING_SCHEMA_VERSION, F.lit(False)), "invalid_schema_version")
            .otherwise(F.coalesce(
                _list_code(doc, "interpretations", C.READING_LIMITS["interpretations"], "invalid_interpretations", interpretation,
                           "duplicate_interpretation", "interpretation_id"),
                _list_code(doc, "hypotheses", C.READING_LIMITS["hypotheses"], "invalid_hypotheses", hypothesis, "duplicate_hypothesis", "hypothesis_id"),
                _ids_code(doc, "recommendation_ids", F.col("allowed_recommendation")),
                _ids_code(doc, "evidence_needed_ids", F.array(*[F.lit(x) for x in C.EVIDENCE_NEEDED_IDS])),
                _ids_code(doc, "insufficient_evidence_ids", F.col("allowed_insufficient"))))
        )

    return let(F.try_parse_json(raw), check)


def audit(selections: DataFrame, allowed: DataFrame, group_cols: Sequence[str], raw: str = "raw") -> DataFrame:
    """Selections with ``error_code`` (null = accepted). ``allowed`` has one row per batch."""
    return selections.join(allowed, list(group_cols), "left").withColumn("error_code", audit_code(F.col(raw)))


def unknown_ids(selections: DataFrame, eligible: DataFrame, group_cols: Sequence[str], key: str, raw: str = "raw") -> DataFrame:
    """Selected ids that the batch's catalog does not allow."""
    doc = F.try_parse_json(raw)
    picked = selections.select(key, *group_cols, F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.try_variant_get(doc, f"$.{field}", "array<string>").alias("ids"))
        for kind, field in (("recommendation", "recommendation_ids"), ("insufficient", "insufficient_evidence_ids"))])))
    ids = picked.select(key, *group_cols, "kind", F.explode("ids").alias("id"))
    return ids.join(eligible, [*group_cols, "kind", "id"], "left_anti")


def catalog_violations(selections: DataFrame, allowed: DataFrame, group_cols: Sequence[str], key: str, raw: str = "raw") -> DataFrame:
    """(key, batch, kind, id, ref, rule): every id of any list, fact reference and validation that the catalog or the batch's facts don't allow.

    ``allowed`` has one row per batch. An entry that is no string has a null id or ref. :func:`audit` judges the layout."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<kind:string,id:string,ref:string,rule:string>>")
    among = lambda values, v: F.coalesce(F.array_contains(F.array_compact(values), v), F.lit(False))

    def row(kind: str, name: Column, ref: Column, rule: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("id"), ref.alias("ref"), rule.alias("rule"))

    def ids(kind: str, values: Column, catalog: Column) -> Column:
        return F.transform(values, lambda v: row(kind, v, none, F.when(~among(catalog, v), "ineligible_id")))

    def entries(kind: str, items: Column, refs_of: dict[str, Sequence[str]]) -> Column:
        def entry(item: Column, name: Column) -> Column:
            refs, checked = _strings(_items(item, "fact_refs")), _text(item, "$.validation_needed_id")
            rows = [
                ids(kind, F.array(name), F.col(f"allowed_{kind}")),
                F.when(F.size(refs) > 0, F.transform(refs, lambda r: row(kind, name, r, F.when(
                    ~among(F.col("known_facts"), r), "unknown_fact").when(~among(_allowed(refs_of, name), r), "ref_not_allowed"))))
                .otherwise(F.array(row(kind, name, none, F.lit("without_refs"))))]
            if kind == "hypothesis":
                rows.append(F.array(row(kind, name, checked, F.when(
                    ~among(_allowed(C.HYPOTHESIS_VALIDATIONS, name), checked), "validation_not_allowed"))))
            return F.concat(*rows)

        return F.flatten(F.transform(items, lambda item: let(_text(item, f"$.{kind}_id"), lambda name: entry(item, name))))

    def found(doc: Column) -> Column:
        lists = [
            entries("interpretation", _items(doc, "interpretations"), C.INTERPRETATION_FACTS),
            entries("hypothesis", _items(doc, "hypotheses"), C.HYPOTHESIS_FACTS),
            ids("recommendation", _strings(_items(doc, "recommendation_ids")), F.col("allowed_recommendation")),
            ids("evidence", _strings(_items(doc, "evidence_needed_ids")), F.array(*[F.lit(x) for x in C.EVIDENCE_NEEDED_IDS])),
            ids("insufficient", _strings(_items(doc, "insufficient_evidence_ids")), F.col("allowed_insufficient"))]
        return F.filter(F.concat(*[F.coalesce(x, empty) for x in lists]), lambda x: x["rule"].isNotNull())

    return selections.join(allowed, list(group_cols), "left").select(key, *group_cols, F.inline(let(F.try_parse_json(raw), found)))
