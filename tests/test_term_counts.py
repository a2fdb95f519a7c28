"""Words and pairs counted in the tasks, against counters."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vozlake.operators import fitting, terms


@pytest.mark.parametrize("held", [1, 25, 1 << 20])
def test_counts_equal_counters(spark, held):
    rnd = random.Random(held)
    rows = [(rnd.choice(["x", "y", None]), rnd.choice([1, 2, None]), rnd.choices(["a", "b", "ü", "d"], k=rnd.randrange(8))) for _ in range(200)]
    rows += [("x", 1, None), ("z", 1, None)]
    df = spark.createDataFrame(rows, "g string, h long, t array<string>").coalesce(2)
    expected = {"df": Counter(), "tf": Counter()}
    for g, h, t in rows:
        found = [] if t is None else ["", *t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]
        expected["tf"].update((g, h, x) for x in found)
        expected["df"].update((g, h, x) for x in set(found))
    old, terms.HELD = terms.HELD, held
    try:
        partial = terms.partial_counts(df, F.col("t"), ["g", "h"])
        got = partial.groupBy("g", "h", "feature").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("df > 0").collect()
        if held > 1:
            # equal terms of a task are one row before the shuffle
            assert partial.coalesce(1).count() < sum(expected["df"].values())
    finally:
        terms.HELD = old
    for name, counts in expected.items():
        assert {(r.g, r.h, r.feature): r[name] for r in got} == counts
    plain = terms.partial_counts(df.filter("false"), F.col("t"))
    assert plain.filter("df > 0").count() == 0


def test_terms_are_summed_before_they_move(spark):
    df = spark.createDataFrame([(i, "quick brown foxes", "Negativo") for i in range(300)], "doc_id long, text string, expected string").coalesce(1)
    found = fitting.fit_tfidf(df, max_df=1.0)
    assert {(r.feature, r.df, r.corpus_count) for r in found.collect()} == {(f, 300, 300) for f in ("quick", "brown", "foxes", "quick brown", "brown foxes")}
