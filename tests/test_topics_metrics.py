"""Topics, Pareto and metrics: known answers and a brute-force comparison."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vozlake.operators import evaluation as ev
from vozlake.operators import metrics, scoring, topics


def pareto_of(spark, counts, bounded):
    df = spark.createDataFrame(list(counts.items()), "topic string, frequency long")
    return [(r.topic, r.percentage, r.cumulative_percentage, r.within_80_percent) for r in topics.pareto(df, bounded=bounded).orderBy("rank").collect()]


@pytest.mark.parametrize("bounded", [True, False])
def test_pareto_known_values(spark, bounded):
    assert pareto_of(spark, {"a": 5, "b": 3, "c": 2}, bounded) == [("a", 50.0, 50.0, True), ("b", 30.0, 80.0, True), ("c", 20.0, 100.0, False)]
    assert [x[3] for x in pareto_of(spark, {"a": 6, "b": 3, "c": 1}, bounded)] == [True, True, False]
    assert [x[0] for x in pareto_of(spark, {"beta": 2, "alfa": 2, "cero": 0}, bounded)] == ["alfa", "beta"]


def test_pareto_of_nothing_keeps_its_columns(spark):
    df = spark.createDataFrame([], "topic string, frequency long")
    assert topics.pareto(df, bounded=True).columns == ["rank", "topic", "frequency", "percentage", "cumulative_percentage", "within_80_percent"]
    assert topics.pareto(df, bounded=True).count() == 0


def test_pareto_threshold_range(spark):
    with pytest.raises(ValueError):
        topics.pareto(spark.createDataFrame([("a", 1)], "topic string, frequency long"), threshold=0)


def greedy(comments, max_topics):
    """The selection rule as a plain loop."""
    df = Counter()
    for words in comments:
        df.update(set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])})
    chosen, covered = [], set()
    for topic, n in sorted(df.items(), key=lambda kv: (-kv[1], -len(kv[0].split()), kv[0])):
        if " " not in topic and topic in covered:
            continue
        chosen.append((topic, n))
        if " " in topic:
            covered.update(topic.split())
        if len(chosen) == max_topics:
            break
    return chosen


def test_selection_equals_the_greedy_loop(spark):
    rng = random.Random(7)
    data, expected = [], {}
    for batch in range(40):
        comments = [[rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(1, 9))]
        data += [(batch, " ".join(words)) for words in comments]
        expected[batch] = greedy(comments, 6)
    df = spark.createDataFrame(data, "batch int, text string")
    found = topics.select_topics(topics.document_frequency(df, ["batch"], stop_words=None), ["batch"], max_topics=6)
    got = {}
    for r in found.orderBy("batch", "rank").collect():
        got.setdefault(r.batch, []).append((r.topic, r.frequency))
    assert got == {k: v for k, v in expected.items() if v}


def test_selection_without_groups(spark):
    comments = [["aa", "bb"], ["aa", "bb"], ["aa", "cc"], ["dd"]]
    df = spark.createDataFrame([(" ".join(c),) for c in comments], "text string")
    found = topics.select_topics(topics.document_frequency(df, stop_words=None), max_topics=3)
    assert [(r.topic, r.frequency) for r in found.orderBy("rank").collect()] == greedy(comments, 3)


def test_null_batches_survive(spark):
    df = spark.createDataFrame([(None, "mal servicio roto"), ("s", "otro roto")], "batch string, text string")
    found = topics.select_topics(topics.document_frequency(df, ["batch"], stop_words=None), ["batch"])
    assert {r.batch for r in found.collect()} == {None, "s"}


def scored(spark, rows):
    return spark.createDataFrame(rows, "batch string, sentiment string, confidence double")


def test_metrics_known_values(spark):
    df = scored(spark, [("b", "Positivo", 0.9), ("b", "Positivo", 0.8), ("b", "Negativo", 0.7), ("b", "Neutro", 0.6)])
    r = metrics.sentiment_metrics(df, ["batch"]).first()
    assert (r.total, r.positive_negative_ratio, r.mean_confidence) == (4, 2.0, 0.75)
    assert (r.critical_confidence_threshold, r.critical_negative_count) == (0.825, 0)


def test_ratio_edges_and_batches_without_negatives(spark):
    df = scored(spark, [("inf", "Positivo", 0.9), ("zero", "Neutro", 0.5), (None, "Negativo", 0.5)])
    found = {r.batch: r for r in metrics.sentiment_metrics(df, ["batch"]).collect()}
    assert found["inf"].positive_negative_ratio == float("inf")
    assert found["zero"].positive_negative_ratio == 0.0
    assert found[None].critical_negative_count == 1


def test_distribution_keeps_zero_classes(spark):
    df = scored(spark, [("b", "Positivo", 0.9)])
    got = [(r.sentiment, r["count"]) for r in metrics.sentiment_distribution(metrics.sentiment_metrics(df, ["batch"]), ["batch"]).orderBy("position").collect()]
    assert got == [("Negativo", 0), ("Neutro", 0), ("Positivo", 1)]


LABELS = ("Negativo", "Neutro", "Positivo")


def from_matrix(spark, matrix):
    rows = [(e, p) for i, e in enumerate(LABELS) for j, p in enumerate(LABELS) for _ in range(matrix[i][j])]
    return ev.confusion_counts(spark.createDataFrame(rows, "expected string, sentiment string"))


def test_published_matrices(spark):
    manual = ev.summary(from_matrix(spark, [[11, 4, 5], [11, 4, 5], [3, 1, 16]])).first()
    assert (round(manual.accuracy, 4), round(manual.macro_f1, 4)) == (0.5167, 0.4868)
    demo = ev.summary(from_matrix(spark, [[66, 0, 8], [10, 1, 4], [3, 1, 11]])).first()
    assert (demo.accuracy, round(demo.macro_f1, 4), round(demo.weighted_f1, 4)) == (0.75, 0.5198, 0.7143)
    f1 = [round(r.f1, 4) for r in ev.class_metrics(from_matrix(spark, [[66, 0, 8], [10, 1, 4], [3, 1, 11]])).collect()]
    assert f1 == [0.8627, 0.1176, 0.5789]


def test_undefined_class_metrics_are_zero_and_accuracy_null(spark):
    r = [x for x in ev.class_metrics(from_matrix(spark, [[1, 0, 0], [0, 0, 0], [0, 0, 1]])).collect() if x["class"] == "Neutro"][0]
    assert (r.precision, r.recall, r.f1, r.support, r.accuracy) == (0.0, 0.0, 0.0, 0, None)


def test_abstention_on_uncovered_cases_is_null(spark):
    cases = spark.createDataFrame([("Negativo", "Negativo", 0.4)], "expected string, sentiment string, confidence double")
    found = ev.abstention_sweep(cases).orderBy("threshold").collect()
    assert [(r.covered_cases, r.selective_accuracy, r.selective_macro_f1, r.abstention_negative) for r in found] == [(0, None, None, 1.0)] * 4


def test_latencies_below_a_hundredth_and_exact_positions(spark):
    from vozlake.operators import costs

    rows = [("tiny", v) for v in (0.001, 0.002, 0.004)] + [("gap", None)] + [("many", float(i)) for i in range(101) for _ in range(2)]
    found = {r.g: r for r in costs.latency_summary(spark.createDataFrame(rows, "g string, latency_ms double"), ["g"]).collect()}
    tiny, many = found["tiny"], found["many"]
    assert (tiny.n, tiny.latency_min, tiny.latency_median, tiny.latency_max) == (3, 0.001, 0.002, 0.004)
    assert tiny.latency_p95 == 0.0038 and tiny.latency_p95_lower == 0.002 and tiny.latency_mean == round(0.007 / 3, 8)
    values = sorted(v for g, v in rows if g == "many")
    at = 0.95 * (len(values) - 1)
    low = int(at)
    assert many.latency_p95_lower == values[low] and abs(many.latency_p95 - (values[low] + (values[low + 1] - values[low]) * (at - low))) < 1e-6
    assert "gap" not in found


def test_scores_and_quantiles_keep_full_precision(spark):
    model = scoring.LinearModel((("casi", 1.0, 0.0, 1e-7, 0.0),), (0.0, 0.0, 0.0))
    row = scoring.score(spark.createDataFrame([("casi igual",)], "text string"), model).first()
    assert row.sentiment == "Neutro" and 0 < row.prediction_margin < 1e-7 and row.second_best_class == "Negativo"
    rows = [("b", "Negativo", 0.5 + k * 1e-9) for k in range(5)]
    found = metrics.sentiment_metrics(spark.createDataFrame(rows, "batch string, sentiment string, confidence double"), ["batch"]).first()
    assert (found.total, found.critical_negative_count) == (5, 2)
