"""Files, contracts, reports, selections, annotation and fitting on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from vozlake import constants as C
from vozlake.operators import annotation as an
from vozlake.operators import fitting, joins, report, scoring, selection
from vozlake.sources import contracts, delimited, journal
from vozlake.streaming import jobs


# --- files ---------------------------------------------------------------------------


def written(tmp_path, text, encoding="utf-8", name="in.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("delimiter", [",", ";", "\t"])
def test_delimiters_are_found(spark, tmp_path, delimiter):
    path = written(tmp_path, f"id{delimiter} texto \n1{delimiter}hola\n2{delimiter}chau\n")
    rows, bad = delimited.read_delimited(spark, path)
    assert rows.columns == ["id", "texto"] and sorted(r.texto for r in rows.collect()) == ["chau", "hola"] and bad.count() == 0


def test_latin1_and_byte_order_mark(spark, tmp_path):
    rows, _ = delimited.read_delimited(spark, written(tmp_path, "id,texto\n1,años\n", "latin-1", "l.csv"))
    assert rows.first().texto == "años"
    rows, _ = delimited.read_delimited(spark, written(tmp_path, "id,texto\n1,años\n", "utf-8-sig", "b.csv"))
    assert rows.columns == ["id", "texto"] and rows.first().texto == "años"


def test_blank_headers_are_numbered():
    assert delimited.clean_names([" a ", " ", "﻿b"]) == ["a", "column_2", "b"]


def test_single_column_keeps_whole_lines(spark, tmp_path):
    rows, _ = delimited.read_delimited(spark, written(tmp_path, "comentario\nbueno, pero caro\nmalo\n"))
    assert sorted(r.comentario for r in rows.collect()) == ["bueno, pero caro", "malo"]


def test_unusable_files_are_refused(spark, tmp_path):
    with pytest.raises(delimited.TableFormatError):
        delimited.sniff(spark, written(tmp_path, "", name="e.csv"))
    with pytest.raises(delimited.TableFormatError):
        delimited.sniff(spark, written(tmp_path, "id,texto\n", name="h.csv"))
    with pytest.raises(delimited.TableFormatError):
        delimited.read_delimited(spark, written(tmp_path, "id,t\n1,a\n2,b\n", name="m.csv"), max_rows=1)
    with pytest.raises(delimited.TableFormatError):
        delimited.read_delimited(spark, written(tmp_path, "c\na\x01b\nc\n", name="c.csv"))


def test_surplus_fields_are_quarantined_for_any_projection(spark, tmp_path):
    rows, bad = delimited.read_delimited(spark, written(tmp_path, "id,texto\n1,a\n2,b,c\n"))
    assert [r.id for r in rows.select("id").collect()] == ["1"]
    assert [r.line for r in bad.collect()] == ["2,b,c"]


def test_journal_rejects_incomplete_records(spark, tmp_path):
    path = str(tmp_path / "journal")
    lines = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1}',), ("broken",)], "raw string")
    rejected = journal.append_records(lines, path, ["a", "b"])
    journal.append_records(lines, path, ["a", "b"])
    assert sorted(r.missing for r in rejected.collect()) == [["a", "b"], ["b"]]
    assert journal.read_records(spark, path, "a int, b int").count() == 2


def test_cost_rows_need_every_field(spark, tmp_path):
    with pytest.raises(ValueError):
        journal.append_costs(spark.createDataFrame([("c",)], "case_id string"), str(tmp_path / "costs"))


def test_file_digest_is_sha256_of_the_bytes(spark, tmp_path):
    import hashlib

    path = written(tmp_path, "hola", name="d.txt")
    digest = hashlib.sha256(b"hola").hexdigest()
    assert contracts.file_digests(spark, path, "texto").first().identity == f"{digest}:texto"
    assert contracts.frozen(spark, path, digest).first().unchanged


def test_benchmark_report(spark):
    df = spark.createDataFrame([("a", None)], "text string, label string")
    assert tuple(contracts.benchmark_report(df, ["text", "label"]).first()) == (True, 1, 1, False)
    assert not contracts.benchmark_report(df, ["label", "text"]).first().columns_ok


# --- joins ------------------------------------------------------------------------------


def test_repeated_keys_fail_a_one_to_one_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "id int, x string")
    right = spark.createDataFrame([(1, "c")], "id int, y string")
    with pytest.raises(Exception, match="key repeats"):
        joins.one_to_one(left, right, "id").collect()
    assert [tuple(r) for r in joins.one_to_one(left.limit(1), right, "id").collect()] == [(1, "a", "c")]


def test_leak_guard_refuses_reference_columns(spark):
    df = spark.createDataFrame([(1, "a", "Neutro")], "id int, text string, expected_sentiment string")
    assert joins.leak_guard(df, "id", "text").columns == ["id", "text"]
    with pytest.raises(ValueError):
        joins.leak_guard(df, "id", "expected_sentiment")


# --- annotation ---------------------------------------------------------------------------


def pairs(spark, items):
    return spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(items)], "case_id string, label_a string, label_b string")


def test_kappa_edges(spark):
    same = an.agreement(pairs(spark, [("Neutro", "Neutro")] * 3)).first()
    assert (same.completed_overlap, same.raw_agreement, same.cohen_kappa) == (3, 1.0, 1.0)
    mixed = an.agreement(pairs(spark, [("Neutro", "Neutro"), ("Negativo", "Negativo"), ("Neutro", "Negativo"), ("Negativo", "Neutro")])).first()
    assert (mixed.raw_agreement, mixed.cohen_kappa) == (0.5, 0.0)
    none = an.agreement(pairs(spark, [])).first()
    assert (none.completed_overlap, none.raw_agreement, none.cohen_kappa) == (0, None, None)


def test_header_and_mode_are_checked(spark):
    df = spark.createDataFrame([(1, "x")], "row_number int, confidence string")
    assert {r.rule for r in an.validate(df, "blind").collect()} == {"header_order", "header_forbidden"}
    with pytest.raises(ValueError):
        an.validate(df, "other")


@pytest.mark.parametrize("value, good", [
    ("2024-05-01T10:00:00Z", True), ("2024-05-01Z", True), ("2024-05-01T10:00:00.123Z", True), ("2024-05-01T10:00:00", False), ("2024-02-30T10:00:00Z", False), ("Z", False)])
def test_utc_timestamps(spark, value, good):
    assert spark.createDataFrame([(value,)], "v string").select(an.is_utc_timestamp(F.col("v")).alias("x")).first().x is good


def test_first_of_a_repeated_id_is_kept(spark):
    df = spark.createDataFrame([(2, "a"), (3, "a"), (4, ""), (5, "b")], "row_number int, case_id string")
    assert sorted(r.row_number for r in an.identifier_violations(df).collect()) == [3, 4]


# --- reports --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def batch_registry(spark):
    rows = [("n", "servicio terrible roto", "Negativo", 0.9), ("n", "servicio bueno", "Positivo", 0.8), ("p", "bueno", "Positivo", 0.7)]
    scored = spark.createDataFrame(rows, "batch string, text string, sentiment string, confidence double")
    return report.facts(*report.batch_tables(scored, ["batch"]), ["batch"])


def test_facts_of_a_batch_without_negatives(batch_registry):
    facts = {r.fact_id: r for r in batch_registry.filter("batch = 'p'").collect()}
    assert facts["sentiment.positive_negative_ratio"].value_text == "undefined_no_negative_comments"
    assert facts["lexical.selected_frequency_sum"].value_num == 0 and not any(k.startswith("lexical.rank") for k in facts)


def test_lineage_holds_and_breaks(batch_registry):
    assert all(r.links_exist and r.value_follows for r in report.lineage(batch_registry, ["batch"]).collect())
    wrong = batch_registry.withColumn("value_num", F.when(F.col("fact_id") == "sentiment.negative.share", 1.0).otherwise(F.col("value_num")))
    broken = {(r.batch, r.fact_id) for r in report.lineage(wrong, ["batch"]).filter("not value_follows").collect()}
    assert broken == {("n", "sentiment.negative.share"), ("p", "sentiment.negative.share")}


def test_eligibility_follows_the_facts(batch_registry):
    found = {}
    for r in report.eligible(batch_registry, ["batch"]).collect():
        found.setdefault(r.batch, set()).add(r.id)
    assert "no_negative_comments" in found["p"] and "review_negative_distribution" not in found["p"]
    assert "review_negative_distribution" in found["n"] and "no_negative_comments" not in found["n"]


def test_payload_holds_no_comment_text_or_topics(batch_registry):
    for row in report.evidence_payload(batch_registry, ["batch"]).collect():
        data = json.loads(row.payload)
        assert data["schema_version"] == "2.0" and len(data["facts"]) >= 13
        assert "servicio" not in row.payload and "terrible" not in row.payload


def test_payload_size(spark):
    df = spark.createDataFrame([("abcdefghi",), ("a",)], "p string")
    assert [tuple(r.x) for r in df.select(report.payload_size(F.col("p")).alias("x")).collect()] == [(9, 2), (1, 1)]


def test_selection_codes(spark, batch_registry):
    base = {"schema_version": "2.0", "interpretations": [], "hypotheses": [], "recommendation_ids": [], "evidence_needed_ids": [], "insufficient_evidence_ids": []}
    ref = {"interpretation_id": "review_negative_distribution", "fact_refs": ["sentiment.negative.count"]}
    cases = [
        ("n", base, None), ("n", {**base, "interpretations": [ref]}, None), ("p", {**base, "interpretations": [ref]}, "ineligible_interpretation"),
        ("n", {**base, "interpretations": [{**ref, "fact_refs": ["sentiment.neutral.count"]}]}, "invalid_interpretation_fact_refs"),
        ("n", {**base, "interpretations": [ref, ref]}, "duplicate_interpretation"), ("n", {**base, "interpretations": {}}, "invalid_interpretations"),
        ("n", {**base, "schema_version": 2}, "invalid_schema_version"), ("n", {**base, "x": 1}, "invalid_root_fields"), ("n", [], "invalid_root_type"),
        ("n", {**base, "recommendation_ids": ["a", "a"]}, "duplicate_recommendation"), ("n", {**base, "evidence_needed_ids": [1]}, "invalid_evidence_needed_ids"),
        ("n", {**base, "insufficient_evidence_ids": ["no_negative_comments"]}, "ineligible_insufficient_evidence"),
    ]
    df = spark.createDataFrame([(i, b, json.dumps(v)) for i, (b, v, _) in enumerate(cases)], "i int, batch string, raw string")
    got = selection.audit(df, report.eligible_arrays(batch_registry, ["batch"]), ["batch"]).orderBy("i").collect()
    assert [r.error_code for r in got] == [c for _, _, c in cases]


# --- fitting and streaming ------------------------------------------------------------------------


def test_fitted_table_scores_like_its_training_signal(spark):
    words = {"Negativo": "roto terrible", "Neutro": "factura entrega", "Positivo": "bueno excelente"}
    rows = [(i, f"{words[c]} producto {i % 3}x", c) for i in range(12) for c in C.CLASSES]
    df = spark.createDataFrame([(i, t, c) for i, (_, t, c) in enumerate(rows)], "doc_id int, text string, expected string")
    table = fitting.fit_logreg(df, fitting.fit_tfidf(df))
    model = scoring.LinearModel.from_table(table)
    got = scoring.score(scoring.prepare(df), model).select("expected", "sentiment", "confidence").collect()
    assert all(r.expected == r.sentiment for r in got)
    assert model.rows == scoring.LinearModel.from_table(model.to_table(spark)).rows


def test_oversized_tables_are_refused(spark):
    table = scoring.LinearModel.starter().to_table(spark)
    with pytest.raises(ValueError):
        scoring.LinearModel.from_table(table, limit=10)


def test_comment_without_known_words_gets_the_base_rate(spark):
    df = spark.createDataFrame([(1, "zzz qqq")], "doc_id int, text string")
    row = scoring.score(df).first()
    assert row.n_features == 0 and row.sentiment == "Positivo" and 0 < row.confidence < 1


def test_long_comments_are_scored_whole(spark):
    df = spark.createDataFrame([(1, "hola " * 30000 + "terrible roto pésimo")], "doc_id int, text string")
    assert scoring.score(df).first().n_features == 3


def test_repeated_stream_run_adds_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "case_id string, seq int, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).write.parquet(source)

    def run():
        stream = jobs.read_stream(spark, source, schema, "*.parquet")
        jobs.finish(jobs.latest_state(stream, ["case_id"], "seq", str(tmp_path / "out"), str(tmp_path / "ck")))
        jobs.finish(jobs.append(jobs.journal(stream, ["v"]), str(tmp_path / "log"), str(tmp_path / "ck2")))

    run()
    run()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    spark.createDataFrame([("a", 2, "z"), ("c", 1, None)], schema).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    state = jobs.read_latest(spark, str(tmp_path / "out"), ["case_id"], "seq")
    assert {r.case_id: r.v for r in state.collect()} == {"a": "z", "b": "y", "c": None}
