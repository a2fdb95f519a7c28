"""Reduction to rows that have a reference, below and above the size that is broadcast."""

from pyspark.sql import functions as F

from vozlake.operators import joins, scoring


def test_same_answer_on_both_sides_of_the_limit(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("the and").alias("text"))
    references = spark.createDataFrame([(3, "a"), (3, "a"), (5, "b"), (None, "c"), (5000, "d")], "k long, expected string")
    few = joins.only_keys(rows, references, "k")
    assert sorted(r.k for r in few.collect()) == [3, 5]
    assert joins.only_keys(rows, references, "k", limit=2).count() == 1000
    assert joins.only_keys(rows, references.filter("false"), "k").count() == 0


def test_the_reduction_lies_below_the_score(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("the and").alias("text"))
    references = spark.createDataFrame([(3, "a")], "k long, expected string")
    plan = scoring.score(joins.only_keys(rows, references, "k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")
