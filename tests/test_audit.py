"""Corpus audits on small inputs, with one class or value holding most rows."""

import math
from collections import Counter

from pyspark.sql import functions as F

from vozlake.functions import text as tx
from vozlake.operators import audit, routing


def corpus(spark):
    rows = [(i, "big" if i % 10 else "small", f"texto numero {i % 3} de prueba. otra frase con cinco palabras {i % 50}") for i in range(2000)]
    return spark.createDataFrame(rows, "id int, label string, text string")


def test_split_is_exact_per_class_and_repeatable(spark):
    df = corpus(spark)
    first = {r.id: r.split for r in audit.stratified_split(df, "id", "label").collect()}
    again = {r.id: r.split for r in audit.stratified_split(df.repartition(13), "id", "label").collect()}
    assert first == again and len(first) == 2000
    sizes = Counter(r.label for r in df.collect())
    tests = Counter(r.label for r in df.collect() if first[r.id] == "test")
    assert tests == {k: math.ceil(n * 0.2) for k, n in sizes.items()}


def test_other_seeds_draw_other_rows(spark):
    df = corpus(spark)
    draws = [{r.id for r in audit.stratified_split(df, "id", "label", seed=s).filter("split = 'test'").collect()} for s in (1, 2)]
    assert draws[0] != draws[1]


def test_duplicates_and_conflicts(spark):
    df = spark.createDataFrame([("Bueno!", "a"), ("Bueno!", "a"), ("bueno!", "b"), ("malo", "a")], "text string, label string")
    clean = tx.historical_clean(F.col("text"))
    found = {r.check: (r.rows, r.duplicates) for r in audit.duplicates(df, {"exact": F.col("text"), "clean": clean}).collect()}
    assert found == {"exact": (4, 1), "clean": (4, 2)}
    assert [(r.labels, r.rows) for r in audit.label_conflicts(df, clean, "label").collect()] == [(2, 3)]


def test_leakage_counts_test_rows_once(spark):
    rows = [(1, "train", "uno dos tres cuatro. a b c d"), (2, "test", "UNO dos tres cuatro! a b c d. nada que ver aqui"), (3, "test", "frase sin nada en comun")]
    df = spark.createDataFrame(rows, "id int, split string, text string")
    assert tuple(audit.leakage(df, "id").first()) == (2, 1, 50.0)


def test_digest_ignores_order_but_not_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    same = [tuple(audit.table_digest(x, ["id", "v"]).first()) for x in (df, df.orderBy(F.col("id").desc()))]
    assert same[0] == same[1] != tuple(audit.table_digest(df.union(df), ["id", "v"]).first())


def test_budget_of_a_batch_that_holds_most_rows(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"b{i}") for i in range(900)], "k int, batch string").repartition(8)
    granted = routing.grant(df, F.lit(True), "k", 5, ["batch"]).filter("granted")
    hot = sorted(r.k for r in granted.filter("batch = 'hot'").collect())
    assert hot == [1, 2, 4, 5, 7] and granted.count() == 5 + 300


def test_split_keeps_null_classes_keys_and_repeats(spark):
    rows = [(i, None if i < 60 else "a") for i in range(100)] + [(None, "a")] * 3 + [(7, "b")] * 4
    out = audit.stratified_split(spark.createDataFrame(rows, "id long, label string"), "id", "label")
    got = out.collect()
    assert len(got) == len(rows) and {r.split for r in got} == {"test", "train"}
    assert sum(r.split == "test" for r in got if r.label is None) == 12
    assert len({r.split for r in got if r.id is None}) == 1
    # all rows of one key go together
    assert {r.split for r in got if r.label == "b"} == {"test"}
    assert audit.stratified_split(spark.createDataFrame([], "id long, label string"), "id", "label").count() == 0


def test_table_digest_tells_nulls_and_borders_apart(spark):
    def of(*row):
        return audit.table_digest(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first().digest

    assert len({of("x|y", "z"), of("x", "y|z"), of(None, "~"), of("~", None), of("~", "~"), of("", None), of("-", "")}) == 7
