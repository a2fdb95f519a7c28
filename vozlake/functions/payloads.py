"""Checks of external verdicts held as raw JSON text.

Each check is one ``when`` chain over (row present, transport error, raw text);
the first failing rule gives the error code. Every function returns a struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vozlake import constants as C
from vozlake.functions.text import let, strip

_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _parsed(raw: Column) -> Column:
    """struct<v variant, keys array<string>, valid boolean>; of a repeated key the last value counts."""
    keys = F.json_object_keys(raw)
    repeated = F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))
    # the strict parser refuses repeated keys; a map keeps them all, in order
    entries = F.map_entries(F.from_json(raw, "map<string,variant>"))
    names = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    value = F.coalesce(F.try_parse_json(raw), F.when(repeated, F.to_variant_object(F.map_from_entries(last))))
    return F.struct(value.alias("v"), keys.alias("keys"), value.isNotNull().alias("valid"))


def _string(p: Column, field: str) -> Column:
    return F.try_variant_get(p["v"], f"$.{field}", "string")


def _type(p: Column, field: str) -> Column:
    """JSON type name; null when the field is absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(p["v"], f"$.{field}", "variant"))


def _keys_are(p: Column, *names: str) -> Column:
    keys = F.array_sort(F.array_distinct(p["keys"]))
    return F.coalesce(keys == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def _blank(raw: Column) -> Column:
    return F.coalesce(strip(raw) == "", F.lit(True))


def _transport(present: Column, transport: Column):
    return F.when(~present, F.lit("unavailable")).when(transport.isNotNull(), transport)


def _is_class(p: Column) -> Column:
    text = _type(p, "sentiment") == "STRING"
    return F.coalesce(text & _string(p, "sentiment").isin(list(C.CLASSES)), F.lit(False))


def review(present: Column, transport: Column, raw: Column) -> Column:
    """Second-check contract: sentiment, optional confidence and rationale."""

    def check(p: Column) -> Column:
        extra = F.size(F.array_except(p["keys"], F.array(F.lit("sentiment"), F.lit("confidence"), F.lit("rationale")))) > 0
        number = _type(p, "confidence")
        value = F.try_variant_get(p["v"], "$.confidence", "double")
        bad_number = F.coalesce(
            (number != "VOID") & ~(number.rlike(_NUMBER) & F.coalesce(value.between(0, 1), F.lit(False))), F.lit(False))
        note = _type(p, "rationale")
        code = (
            _transport(present, transport)
            .when(_blank(raw), "empty_response")
            .when(~p["valid"], "invalid_json")
            .when(p["keys"].isNull() | extra | ~_is_class(p), "invalid_sentiment")
            .when(bad_number, "invalid_confidence")
            .when(F.coalesce(~note.isin("VOID", "STRING"), F.lit(False)), "invalid_rationale")
        )
        return let(code, lambda c: _outcome(c, p, value, _rationale(p)))

    return let(_parsed(raw), check)


def _rationale(p: Column) -> Column:
    text = F.when(_type(p, "rationale") == "STRING", _string(p, "rationale"))
    return F.when(text != "", F.substring(strip(text), 1, 240))


def _outcome(code: Column, p: Column, confidence: Column | None = None, rationale: Column | None = None) -> Column:
    ok = code.isNull()
    return F.struct(
        ok.alias("success"), F.when(ok, _string(p, "sentiment")).alias("sentiment"),
        F.when(ok, confidence if confidence is not None else F.lit(None).cast("double")).alias("confidence"),
        F.when(ok, rationale if rationale is not None else F.lit(None).cast("string")).alias("rationale"),
        code.alias("error_code"),
    )


def direct(present: Column, transport: Column, raw: Column, finish_reason: Column) -> Column:
    """Strict one-field contract; a truncated completion beats every payload rule."""

    def check(p: Column) -> Column:
        code = (
            _transport(present, transport)
            .when(F.coalesce(finish_reason == "length", F.lit(False)), "completion_truncated")
            .when(~F.coalesce(p["valid"], F.lit(False)), "invalid_json")
            .when(~_keys_are(p, "sentiment"), "invalid_schema")
            .when(~_is_class(p), "invalid_sentiment")
        )
        return let(code, lambda c: _outcome(c, p))

    return let(_parsed(raw), check)


def translation(present: Column, transport: Column, raw: Column, source_language: Column) -> Column:
    """struct<success, translated_text, error_code>."""

    def check(p: Column) -> Column:
        text = F.when(_type(p, "translated_text") == "STRING", strip(_string(p, "translated_text")))
        code = (
            _transport(present, transport)
            .when(_blank(raw), "empty_response")
            .when(~p["valid"], "invalid_json")
            .when(~_keys_are(p, "source_language", "translated_text"), "invalid_schema")
            .when(~F.coalesce(_string(p, "source_language") == source_language, F.lit(False)), "source_mismatch")
            .when(F.coalesce(text == "", F.lit(True)), "empty_translation")
        )
        return let(code, lambda c: F.struct(
            c.isNull().alias("success"), F.when(c.isNull(), text).alias("translated_text"), c.alias("error_code")))

    return let(_parsed(raw), check)


def variant(present: Column, transport: Column, raw: Column, contract: Column, max_rationale: int = 120) -> Column:
    """Two-contract check with a parse status, chosen per row by ``contract``."""

    def check(p: Column) -> Column:
        long_form = contract == "sentiment_rationale"
        keys_ok = F.when(long_form, _keys_are(p, "sentiment", "rationale")).otherwise(_keys_are(p, "sentiment"))
        note_ok = F.coalesce((_type(p, "rationale") == "STRING") & (F.length(_string(p, "rationale")) <= max_rationale), F.lit(False))
        code = (
            _transport(present, transport)
            .when(_blank(raw), "empty_response")
            .when(~p["valid"], "invalid_json")
            .when(~keys_ok, "invalid_schema")
            .when(~_is_class(p), "invalid_sentiment")
            .when(long_form & ~note_ok, "invalid_rationale")
        )
        status = (
            F.when(~present | transport.isNotNull(), F.lit(None).cast("string"))
            .when(_blank(raw), "empty").when(~p["valid"], "invalid_json")
            .when(code.isNotNull(), "schema_violation").otherwise("valid")
        )
        return F.struct(
            code.isNull().alias("success"), F.when(code.isNull(), _string(p, "sentiment")).alias("sentiment"),
            F.when(code.isNull() & long_form, _string(p, "rationale")).alias("rationale"),
            code.alias("error_code"), status.alias("parse_status"))

    return let(_parsed(raw), check)


def usage(names: Sequence[str] = ("prompt_tokens", "completion_tokens")) -> Column:
    """Token usage as a map of the counters that are present, null if none is."""
    entries = F.array_compact(F.array(*[
        F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("key"), F.col(n).cast("long").alias("value"))) for n in names]))
    return let(entries, lambda e: F.when(F.size(e) > 0, F.map_from_entries(e)))
