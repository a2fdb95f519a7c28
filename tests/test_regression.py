"""Fold-parallel regression against a dense solver, its certificate, and indexed scoring against the literal model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vozlake import constants as C
from vozlake.operators import fitting, indexed, regression, scoring


def dense(x, y, s, strength, steps=60):
    """Newton's method on the whole matrix; intercepts last and free."""
    n, k = len(x), len(C.CLASSES)
    x = np.column_stack([x, np.ones(n)])
    w, ridge = np.zeros((x.shape[1], k)), np.append(np.full(x.shape[1] - 1, 1 / (strength * n)), 0.0)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (s[:, None] * (p - np.eye(k)[y])) / n + ridge[:, None] * w
        h = np.zeros((x.shape[1] * k,) * 2)
        for a in range(k):
            for b in range(k):
                block = x.T @ ((s * p[:, a] * ((a == b) - p[:, b]))[:, None] * x) / n + (a == b) * np.diag(ridge)
                h[a::k, b::k] = block
        w -= (np.linalg.pinv(h) @ g.ravel()).reshape(w.shape)
    return w


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(3)
    words = {c: [f"{c[:2].lower()}{i}" for i in range(6)] for c in C.CLASSES}
    rows = []
    for i in range(150):
        c = rnd.choices(C.CLASSES, [5, 3, 1])[0]
        text = " ".join(rnd.choice(words[rnd.choice([c, c, rnd.choice(C.CLASSES)])]) for _ in range(rnd.randrange(0, 9)))
        rows.append((i, text, c))
    rows += [(900, None, C.CLASSES[0]), (901, "ne1 ne2", None), (902, "ne1", "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, expected string").repartition(3)


def test_fit_is_the_optimum_and_folds_are_fitted_apart(spark, labelled):
    vocabulary = fitting.fit_tfidf(labelled)
    entries = fitting._entries(vocabulary, 5000)
    index = indexed.FeatureIndex.of(entries)
    rows = regression.rows_of(labelled, index, "text", "expected", F.col("doc_id"), 3)
    got = rows.collect()
    x = np.zeros((len(got), len(entries)))
    for i, r in enumerate(got):
        x[i, r.feature] = r.x
    y, fold = np.array([r.label for r in got]), np.array([r.fold for r in got])
    assert len(got) == 151 and set(fold) == {0, 1, 2}
    fit = regression.fit(rows, len(entries), (0.1, 1.0, 10.0), 3)

    def solved(keep, strength):
        counts = np.bincount(y[keep], minlength=3)
        return dense(x[keep], y[keep], (keep.sum() / (3 * counts))[y[keep]], strength)

    expected = []
    for f in range(3):
        for strength in (0.1, 1.0, 10.0):
            w = solved(fold != f, strength)
            z = np.column_stack([x, np.ones(len(x))])[fold == f] @ w
            expected.append((strength, f, int((fold == f).sum()), int((z.argmax(axis=1) == y[fold == f]).sum())))
    assert sorted(fit.choices) == sorted(expected)
    hits = {s: sum(c[3] for c in expected if c[0] == s) for s in (0.1, 1.0, 10.0)}
    assert fit.strength == max((0.1, 1.0, 10.0), key=hits.get)
    best = solved(fold >= 0, fit.strength)
    centred = lambda w: w - w.mean(axis=1, keepdims=True)  # noqa: E731 - only differences of classes count
    assert np.abs(centred(fit.weights) - centred(best)).max() < 2e-3 * max(1, fit.strength)


def test_fit_reaches_its_optimum_in_few_passes(spark):
    rnd = random.Random(6)
    # frequent words that go together and many rare ones
    rows = []
    for i in range(2000):
        c = rnd.choices(range(3), [8, 1, 1])[0]
        words = [f"w{int(rnd.paretovariate(0.6)) % 400 + 37 * c * (rnd.random() < 0.2)}" for _ in range(rnd.randrange(1, 60))]
        rows.append((i, " ".join(words), C.CLASSES[c]))
    df = spark.createDataFrame(rows, "doc_id long, text string, expected string").repartition(2)
    entries = fitting._entries(fitting.fit_tfidf(df), 5000)
    found = regression.rows_of(df, indexed.FeatureIndex.of(entries), "text", "expected", F.col("doc_id"), 1)
    fit = regression.fit(found, len(entries), (1.0,), 1)
    assert fit.passes <= 40
    gradient = regression._pass(found, [regression._Model(-1, 1.0, fit.weights.ravel())], _balanced(df), len(entries))[1][0] / len(rows)
    pull = fit.weights / len(rows)
    pull[-1] = 0
    assert np.abs(gradient + pull).max() < regression.TOLERANCE * 1.01


def _balanced(df):
    counts = dict(df.groupBy("expected").count().collect())
    return np.array([[sum(counts.values()) / (3 * counts[c]) for c in C.CLASSES]])


def test_certificate_tells_the_optimum_from_other_tables(spark, labelled):
    table = fitting.fit_logreg(labelled, fitting.fit_tfidf(labelled), key_col="doc_id")
    good = regression.certificate(labelled, table, "doc_id").collect()
    assert len(good) == 3 and all(r.largest_gradient < 1e-5 and abs(r.mean_probability - 1 / 3) < 1e-5 for r in good)
    wrong = table.withColumn("w_negativo", F.when(F.col("feature") == "ne1", F.col("w_negativo") + 0.5).otherwise(F.col("w_negativo")))
    assert max(r.largest_gradient for r in regression.certificate(labelled, wrong, "doc_id").collect()) > 1e-3
    other = regression.certificate(labelled, table, "doc_id", inverse_strength=3.0).collect()
    assert max(r.largest_gradient for r in other) > 1e-3


def test_indexed_scores_equal_the_literal_model(spark):
    model = scoring.LinearModel.starter()
    words = [w for r in model.rows for w in r[0].split()]
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice([*words, "x", "other"]) for _ in range(rnd.randrange(0, 30))) for _ in range(200)]
    texts += ["", "of the of the OF THE", "no funciona", "the, and", "funciona no", "ñ é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    names = ["doc_id", *scoring.SCORE_COLUMNS]
    a = sorted(tuple(r) for r in scoring.score(df, model).select(names).collect())
    b = sorted(tuple(r) for r in indexed.score(df, model.to_table(spark)).select(names).collect())
    assert len(a) == len(b) == len(texts)
    for left, right in zip(a, b):
        assert left[1] == right[1] and left[6] == right[6] and left[9] == right[9]
        assert np.allclose([left[i] for i in (2, 3, 4, 5, 7, 8)], [right[i] for i in (2, 3, 4, 5, 7, 8)], atol=1e-12)


def test_indexed_edge_cases(spark):
    table = scoring.LinearModel.starter().to_table(spark)
    none = spark.createDataFrame([(1, None), (2, "trash")], "doc_id long, text string")
    rows = {r.doc_id: r for r in indexed.score(none, table).collect()}
    assert rows[1].n_features == 0 and rows[2].sentiment == "Negativo"
    assert indexed.score(none.filter("false"), table).count() == 0
    bare = table.filter("feature = ''")
    assert {r.sentiment for r in indexed.score(none, bare).collect()} == {"Positivo"}
    with pytest.raises(ValueError):
        indexed.score(none, table, limit=5)
