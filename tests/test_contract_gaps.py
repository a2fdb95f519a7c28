"""Capabilities, payloads read back, packets validated first, texts set aside, encodings per file, strict quotes."""

import pytest
from pyspark.sql import functions as F

from vozlake import constants as C
from vozlake.operators import annotation, report, scoring
from vozlake.sources import delimited

FACT = "batch string, fact_id string, value_num double, value_display double, value_text string, unit string, population string, numerator_fact string, denominator_fact string"


@pytest.fixture()
def registry(spark):
    rows = [("b", f, 3.0, 3.0, None, "comments", "all", None, None) for f in report.COUNT_FACTS]
    rows += [("b", "half", 50.0, 50.0, None, "percent", "all", report.COUNT_FACTS[1], report.COUNT_FACTS[0]),
             ("b", "lost", 1.0, 1.0, None, "percent", "all", "gone", report.COUNT_FACTS[0])]
    return spark.createDataFrame(rows, FACT)


def ids(df, kind):
    return {r.id for r in df.collect() if r.kind == kind}


def test_capabilities_decide(registry):
    flags = {r.capability: r.available for r in report.capabilities(registry, ["batch"], {"time_comparison": True}).collect()}
    assert flags == {c: c == "time_comparison" for c in C.CAPABILITIES}
    none, timed = report.eligible(registry, ["batch"]), report.eligible(registry, ["batch"], {"time_comparison": True})
    assert ids(none, "recommendation") - ids(timed, "recommendation") == {"collect_temporal_baseline"}
    assert ids(none, "insufficient") - ids(timed, "insufficient") == {"no_time_comparison"}
    with pytest.raises(ValueError):
        report.eligible(registry, ["batch"], {"telepathy": True})


def test_payload_reads_back(registry):
    rows = report.read_payload(report.evidence_payload(registry, ["batch"], {"business_targets": True}), ["batch"]).collect()
    parts = {p: {r.name: (r.value, r.text) for r in rows if r.part == p} for p in {r.part for r in rows}}
    assert parts["capability"] == {c: (float(c == "business_targets"), None) for c in C.CAPABILITIES}
    assert parts["limit"] == {k: (float(v), None) for k, v in C.READING_LIMITS.items()}
    assert parts["fact"]["half"] == (50.0, f"|{report.COUNT_FACTS[1]}|{report.COUNT_FACTS[0]}")
    assert "no_business_targets" not in parts["insufficient"] and "no_time_comparison" in parts["insufficient"]


def test_a_broken_fact_shows(registry):
    found = {r.fact_id: (r.links_exist, r.value_follows) for r in report.lineage(registry, ["batch"]).collect()}
    assert found == {"half": (True, False), "lost": (False, False)}


def packet(spark, *rows):
    columns = ["row_number", *C.BLIND_COLUMNS]
    full = {"texto_original_anonimizado": "un texto claro", "source_id": "src-1", "family_id": "fam-1", "source_type": C.SOURCE_TYPES[0], "language": "es",
            "sentiment_subgroup": "other", "annotator_label": C.ANNOTATION_LABELS[0], "uncertainty_reason": "", "annotator_notes": "",
            "taxonomy_version": "sentiment-v1.0.0"}
    data = [tuple({**full, "row_number": k, **r}.get(c, "") for c in columns) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} {'int' if c == 'row_number' else 'string'}" for c in columns))


def test_packets_are_validated_before_they_are_compared(spark):
    good = packet(spark, {"case_id": "case-1"}, {"case_id": "case-2"})
    other = packet(spark, {"case_id": "case-1", "language": "pt"}, {"case_id": "case-3"})
    bad = packet(spark, {"case_id": "case-1"}, {"case_id": "case-1"}, {"case_id": "case 2"})
    assert annotation.validate(good, "blind").collect() == []
    compared = {(r.step, r.subject, r.problem) for r in annotation.check_pair(good, other).collect()}
    assert compared == {("comparison", "case-1", "fields_differ:language"), ("comparison", "case-2", "missing_from_b"), ("comparison", "case-3", "additional_in_b")}
    found = annotation.check_pair(good, bad).collect()
    assert found and {r.step for r in found} == {"packet_b"} and "invalid_case_id" in {r.problem for r in found}


def test_what_is_not_judged_is_listed(spark):
    rows = [(1, "hola"), (2, "x" * 5000), (3, "x" * 5001), (4, " a "), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert {r.id for r in scoring.prepare(df, refuse_long=True).collect()} == {1, 2}
    assert {r.id for r in scoring.prepare(df).collect()} == {1, 2, 3}
    assert {(r.id, r.n_chars, r.reason) for r in scoring.set_aside(df, ["id"]).collect()} == {
        (3, 5001, "too_long"), (4, 1, "too_short"), (5, 0, "too_short"), (6, 0, "too_short")}


def test_each_file_in_its_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,text\n1,canción\n".encode())
    (tmp_path / "b c+%20.csv").write_bytes("id,text\n2,niño\n".encode("latin-1"))
    rows, broken = delimited.read_delimited(spark, str(tmp_path))
    assert {tuple(r) for r in rows.collect()} == {("1", "canción"), ("2", "niño")} and broken.count() == 0


def test_single_values_with_quotes(spark, tmp_path):
    lines = ["comentario", 'dijo "hola" y se fue', '"todo entre comillas"', '"dice ""si"" siempre"', '"abierta', '"cerrada" y mas', 'uno, "dos', 'a, b "c"', '"x",y']
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows, broken = delimited.read_delimited(spark, str(tmp_path))
    assert {r.comentario for r in rows.collect()} >= {'dijo "hola" y se fue', "todo entre comillas", 'dice "si" siempre', 'uno, "dos', 'a, b "c"'}
    assert {r.line for r in broken.collect()} == {'"abierta', '"cerrada" y mas', '"x",y'}


def test_long_lines_are_checked_whole(spark, tmp_path):
    sound, broken = '"' + "a, \"\" " * 60_000 + '"', '"' + "b; " * 60_000
    (tmp_path / "a.txt").write_text("\n".join(["comentario", sound, broken, "x" * 300_000]) + "\n", encoding="utf-8")
    rows, aside = delimited.read_delimited(spark, str(tmp_path))
    assert rows.count() == 2 and [len(r.line) for r in aside.collect()] == [len(broken)]
