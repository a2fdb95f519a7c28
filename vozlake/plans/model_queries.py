"""Queries over model fitting, scoring and language detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions import text as tx
from vozlake.operators import evaluation as ev
from vozlake.operators import fitting, indexed, joins, regression, scoring
from vozlake.plans import oracle as o
from vozlake.plans.registry import Tables, query
from vozlake.plans.text_queries import comments


def scored(t: Tables) -> DataFrame:
    """Scores beside the narrow columns; the text ends here."""
    return scoring.score(comments(t)).drop("text")


o.define("mf_tok", f"SELECT doc_id, regexp_extract_all(lower(text), '{o.W}{{2,}}') AS t FROM prep")
o.define("mf_feat", """SELECT doc_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS feature FROM mf_tok""")
o.define("mf_tf", "SELECT doc_id, feature, count(*) AS tf FROM mf_feat GROUP BY 1, 2")
o.define("mf_fit", """SELECT feature, count(*) AS df, sum(tf)::BIGINT AS corpus_count, (SELECT count(*) FROM prep) AS n_all FROM mf_tf GROUP BY 1""")
_TOP_COEFFICIENT_CLASSES = ("de", "en", "es", "fr")


@query("fit_tfidf", o.with_ctes("""SELECT feature, df, corpus_count, round(ln((1.0::DOUBLE + n_all) / (1.0::DOUBLE + df)) + 1, 9) AS idf FROM mf_fit
    WHERE df >= 3 AND df <= n_all * 0.9 ORDER BY corpus_count DESC, feature LIMIT 5000"""))
def fit_tfidf(t: Tables) -> DataFrame:
    return fitting.fit_tfidf(comments(t))


def labelled(t: Tables) -> DataFrame:
    return comments(t).join(t.derived("truth"), "doc_id").select("doc_id", "text", "expected")


o.define("rl_prep", "SELECT p.doc_id, p.text, t.expected FROM prep p JOIN truth t USING (doc_id)")


@query("fit_logreg", o.with_ctes("""SELECT expected AS class, count(*) AS cases, round(any_value(n) / (3.0::DOUBLE * count(*)), 6) AS class_weight,
    round((any_value(n) / (3.0::DOUBLE * count(*))) * count(*) / any_value(n), 4) AS mean_probability, 0.0::DOUBLE AS largest_gradient
    FROM rl_prep, (SELECT count(*) AS n FROM rl_prep) GROUP BY 1"""))
def fit_logreg(t: Tables) -> DataFrame:
    """The optimality condition of the regression at its fitted weights: no gradient is left, so each class's weighted mean
    probability is its weighted share."""
    rows = cut(labelled(t), "labelled")
    table = fitting.fit_logreg(rows, fitting.fit_tfidf(rows), key_col="doc_id")
    return regression.certificate(rows, table, "doc_id").select(
        "class", "cases", F.round("class_weight", 6).alias("class_weight"), F.round("mean_probability", 4).alias("mean_probability"),
        F.round("largest_gradient", 4).alias("largest_gradient"))


o.define("rl_tok", f"SELECT doc_id, expected, regexp_extract_all(lower(text), '{o.W}{{2,}}') AS t FROM rl_prep")
o.define("rl_feat", "SELECT doc_id, expected, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS feature FROM rl_tok")
o.define("rl_tf", "SELECT doc_id, expected, feature, count(*) AS tf FROM rl_feat GROUP BY 1, 2, 3")
o.define("rl_fit", "SELECT feature, count(*) AS df, sum(tf)::BIGINT AS corpus_count, (SELECT count(*) FROM rl_prep) AS n_all FROM rl_tf GROUP BY 1")
o.define("rl_vocab", """SELECT feature, round(ln((1.0::DOUBLE + n_all) / (1.0::DOUBLE + df)) + 1, 9) AS idf FROM rl_fit
    WHERE df >= 3 AND df <= n_all * 0.9 ORDER BY corpus_count DESC, feature LIMIT 5000""")
_COUNTS = ", ".join(f"sum(CASE WHEN expected = '{c}' THEN tf ELSE 0 END)::BIGINT AS n{k}" for k, c in enumerate(C.CLASSES))
o.define("rl_count", f"SELECT feature, any_value(idf) AS idf, {_COUNTS} FROM rl_tf JOIN rl_vocab USING (feature) GROUP BY 1")
o.define("rl_total", "SELECT count(*) AS v, sum(n0 + n1 + n2)::BIGINT AS mass, sum(n0)::BIGINT AS t0, sum(n1)::BIGINT AS t1, sum(n2)::BIGINT AS t2 FROM rl_count")
_RATIOS = ", ".join(
    f"round(ln(((n{k} + 1.0::DOUBLE) / (t{k} + v)) / ((n0 + n1 + n2 - n{k} + 1.0::DOUBLE) / (mass - t{k} + v))), 6) AS w{k}" for k in range(3))
o.define("rl_coef", f"SELECT row_number() OVER (ORDER BY feature) AS i, feature, idf, {_RATIOS} FROM rl_count, rl_total")
for _key, _cte in o.score_ctes("prep", "doc_id", "text", "rs", "rl_coef", (0.0, 0.0, 0.0)).items():
    o.define(_key, _cte)
o.define("rl_long", "SELECT feature, u.class, u.weight FROM (SELECT feature, unnest([" + ", ".join(
    f"{{'class': '{c}', 'weight': w{k}}}" for k, c in enumerate(C.CLASSES)) + "]) AS u FROM rl_coef)")


def fitted(t: Tables) -> DataFrame:
    """Coefficients fitted on the labelled comments, written as a table and read back."""
    rows = cut(labelled(t), "labelled")
    return cut(fitting.fit_ratio(rows, fitting.fit_tfidf(rows)), "coefficients")


@query("score_fitted", o.with_ctes("""SELECT doc_id, sentiment, confidence, probability_negativo, probability_neutro, probability_positivo, second_best_class,
    prediction_margin, n_features FROM rs"""), scores="confidence probability_negativo probability_neutro probability_positivo prediction_margin")
def score_fitted(t: Tables) -> DataFrame:
    """Every comment scored by a table that was fitted, frozen and read back."""
    return indexed.score(comments(t), fitted(t)).select(
        "doc_id", "sentiment", "confidence", "probability_negativo", "probability_neutro", "probability_positivo", "second_best_class",
        "prediction_margin", "n_features")


@query("fitted_top_coefficients", o.with_ctes("""SELECT class, 'highest' AS side, rank::INTEGER AS rank, feature, weight FROM
    (SELECT *, row_number() OVER (PARTITION BY class ORDER BY weight DESC, feature) AS rank FROM rl_long) WHERE rank <= 25
    UNION ALL SELECT class, 'lowest', rank::INTEGER, feature, weight FROM
    (SELECT *, row_number() OVER (PARTITION BY class ORDER BY weight, feature) AS rank FROM rl_long) WHERE rank <= 25"""))
def fitted_top_coefficients(t: Tables) -> DataFrame:
    return fitting.extreme_coefficients(fitting.coefficients_long(fitted(t)), "class", "feature")


_FITTED_TERMS = (*C.COMMERCIAL_TERMS, "the", "of the", "und", "les", "para", "clown")


@query("fitted_term_coefficients", o.with_ctes(f"""SELECT a.term, {', '.join(f'c.w{k} AS "{c}"' for k, c in enumerate(C.CLASSES))}
    FROM (SELECT DISTINCT unnest([{o.words(_FITTED_TERMS)}]) AS term) a LEFT JOIN rl_coef c ON c.feature = a.term"""))
def fitted_term_coefficients(t: Tables) -> DataFrame:
    return fitting.term_coefficients(fitting.coefficients_long(fitted(t)), _FITTED_TERMS, "class", "feature", C.CLASSES)


@query("score_linear", o.with_ctes("""SELECT doc_id, sentiment, confidence, probability_negativo, probability_neutro, probability_positivo FROM scored"""), scores="confidence probability_negativo probability_neutro probability_positivo")
def score_linear(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", "sentiment", "confidence", "probability_negativo", "probability_neutro", "probability_positivo")


@query("top2_margin", o.with_ctes("SELECT doc_id, sentiment, confidence, second_best_class, second_best_probability, prediction_margin FROM scored"), scores="confidence second_best_probability prediction_margin")
def top2_margin(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", "sentiment", "confidence", "second_best_class", "second_best_probability", "prediction_margin")


@query("predictions_only", o.with_ctes("""SELECT doc_id, text, sentiment AS predicted_sentiment, confidence AS local_confidence, probability_negativo,
    probability_neutro, probability_positivo FROM scored"""), scores="local_confidence probability_negativo probability_neutro probability_positivo")
def predictions_only(t: Tables) -> DataFrame:
    return scoring.score(comments(t).select("doc_id", "text")).select(
        "doc_id", "text", F.col("sentiment").alias("predicted_sentiment"), F.col("confidence").alias("local_confidence"),
        "probability_negativo", "probability_neutro", "probability_positivo")


@query("probability_long", o.with_ctes("SELECT doc_id, name AS class, pr AS probability FROM s0_long"), scores="probability")
def probability_long(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"probability_{c.lower()}").alias("probability")) for c in C.CLASSES])))


o.define("lw_tok", f"SELECT lang, unnest(regexp_extract_all(lower(text), '{o.W}+')) AS word FROM prep")
o.define("lw_per", "SELECT lang, word, count(*) AS n FROM lw_tok GROUP BY 1, 2")
o.define("lw_all", "SELECT count(DISTINCT word) AS vocab, sum(n)::BIGINT AS mass FROM lw_per")
o.define("lw_weight", """SELECT lang, word, n AS count, round(ln(((n + 1.0::DOUBLE) / (ln_ + vocab)) / ((wn - n + 1.0::DOUBLE) / (mass - ln_ + vocab))), 6) AS weight
    FROM (SELECT *, (sum(n) OVER (PARTITION BY word))::BIGINT AS wn, (sum(n) OVER (PARTITION BY lang))::BIGINT AS ln_ FROM lw_per), lw_all WHERE n >= 3""")


@query("fit_language_profiles", o.with_ctes("""SELECT lang, word, count, weight, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS rank
    FROM lw_weight) WHERE rank <= 200"""))
def fit_language_profiles(t: Tables) -> DataFrame:
    return fitting.fit_language_profiles(comments(t))


@query("class_top_coefficients", o.with_ctes("""SELECT lang, 'highest' AS side, rank::INTEGER AS rank, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS rank FROM lw_weight) WHERE rank <= 25
    UNION ALL SELECT lang, 'lowest', rank::INTEGER, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight, word) AS rank FROM lw_weight) WHERE rank <= 25"""))
def class_top_coefficients(t: Tables) -> DataFrame:
    """Strongest features per class of the weights fitted in closed form."""
    return fitting.extreme_coefficients(fitting.language_weights(comments(t)), "lang", "word")


_ASKED = (*C.COMMERCIAL_TERMS, "the", "und", "les", "para")


@query("term_coefficients", o.with_ctes(f"""SELECT a.term, {', '.join(f"max(weight) FILTER (lang = '{c}') AS {c}" for c in _TOP_COEFFICIENT_CLASSES)}
    FROM (SELECT unnest([{o.words(_ASKED)}]) AS term) a LEFT JOIN lw_weight w ON w.word = a.term GROUP BY 1"""))
def term_coefficients(t: Tables) -> DataFrame:
    weights = fitting.language_weights(comments(t))
    return fitting.term_coefficients(weights, _ASKED, "lang", "word", _TOP_COEFFICIENT_CLASSES)


@query("feature_coverage", o.with_ctes("""SELECT source, count(*) AS rows, count(*) FILTER (n_features = 0) AS zero_feature_rows,
    round(avg(n_features), 6) AS mean_nonzero_features FROM scored GROUP BY 1"""))
def feature_coverage(t: Tables) -> DataFrame:
    return scored(t).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_features") == 0).alias("zero_feature_rows"),
        F.round(F.avg("n_features"), 6).alias("mean_nonzero_features"))


@query("vocabulary_lookup", o.with_ctes("SELECT feature, count(DISTINCT doc_id) AS n_docs, count(*) AS occurrences FROM s0_feat JOIN coef USING (feature) GROUP BY 1"))
def vocabulary_lookup(t: Tables) -> DataFrame:
    """Exploded terms against the coefficient table (5 000 rows at most, so broadcast)."""
    terms = fitting.term_counts(comments(t), [], fitting.model_terms(F.col("text")))
    known = scoring.LinearModel.starter().to_table(t.spark).filter("feature <> ''").select("feature")
    return terms.join(F.broadcast(known), "feature").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("occurrences"))


for _key, _cte in o.score_ctes("variant_keyed", "vkey", "text", "sv").items():
    o.define(_key, _cte)
o.define("variant_keyed", "SELECT doc_id || '|' || variant AS vkey, doc_id, variant, text FROM variant_rows")
o.define("variant_scored", """SELECT v.doc_id, v.variant, t.expected, s.sentiment, s.n_features, b.sentiment AS base_sentiment
    FROM variant_keyed v JOIN truth t USING (doc_id) JOIN sv s USING (vkey)
    JOIN (SELECT k.doc_id, z.sentiment FROM variant_keyed k JOIN sv z USING (vkey) WHERE k.variant = 'current_str_strip') b ON b.doc_id = v.doc_id""")
o.define("variant_cls", """SELECT variant, c.name, count(*) FILTER (expected = c.name AND sentiment = c.name) AS tp, count(*) FILTER (expected = c.name) AS sup,
    count(*) FILTER (sentiment = c.name) AS cho FROM variant_scored, classes c GROUP BY 1, 2""")


@query("variant_comparison", o.with_ctes("""SELECT a.variant, a.cases, a.accuracy, f.macro_f1, f.weighted_f1, a.changed_vs_current, a.zero_feature_rows, a.mean_nonzero_features FROM
    (SELECT variant, count(*) AS cases, round(avg((expected = sentiment)::INT), 6) AS accuracy, count(*) FILTER (sentiment <> base_sentiment) AS changed_vs_current,
       count(*) FILTER (n_features = 0) AS zero_feature_rows, round(avg(n_features), 6) AS mean_nonzero_features FROM variant_scored GROUP BY 1) a JOIN
    (SELECT variant, round(avg(2.0::DOUBLE * tp / nullif(sup + cho, 0)) FILTER (true), 6) AS macro_unused,
       round(sum(coalesce(2.0::DOUBLE * tp / nullif(sup + cho, 0), 0)) / 3, 6) AS macro_f1,
       round(sum(coalesce(2.0::DOUBLE * tp / nullif(sup + cho, 0), 0) * sup) / sum(sup), 6) AS weighted_f1 FROM variant_cls GROUP BY 1) f USING (variant)""".replace(
    "round(avg(2.0::DOUBLE * tp / nullif(sup + cho, 0)) FILTER (true), 6) AS macro_unused,\n       ", "")))
def variant_comparison(t: Tables) -> DataFrame:
    """Each normalisation scored once, beside the baseline of the same comment."""
    model = scoring.LinearModel.starter()
    text = F.col("text")
    shapes = {"current_str_strip": tx.prepared(text), "historical_clean": tx.historical_clean(text), "nfkc_whitespace": tx.nfkc_clean(text)}
    documents = joins.only_keys(t.documents.select("doc_id", "text"), t.derived("truth"), "doc_id")
    texts = documents.select("doc_id", *[c.alias(f"t_{k}") for k, c in shapes.items()])
    scores = texts.select("doc_id", F.inline_outer(F.array(F.struct(*[model.score(F.col(f"t_{k}")).alias(k) for k in shapes]))))
    rows = scores.select("doc_id", F.col("current_str_strip.sentiment").alias("base_sentiment"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("variant"), F.col(f"{k}.sentiment").alias("sentiment"), F.col(f"{k}.n_features").alias("n_features")) for k in shapes])))
    cases = rows.join(t.derived("truth"), "doc_id")
    counts = ev.confusion_counts(cases, ["variant"], extra=[
        F.count_if(F.col("sentiment") != F.col("base_sentiment")).alias("changed_vs_current"),
        F.count_if(F.col("n_features") == 0).alias("zero_feature_rows"), F.round(F.avg("n_features"), 6).alias("mean_nonzero_features")])
    return ev.summary(counts, ["variant", "changed_vs_current", "zero_feature_rows", "mean_nonzero_features"])


@query("detect_language", o.with_ctes("SELECT doc_id, detected_language, language_score, runner_up_score, language_status FROM lang_detected"))
def detect_language(t: Tables) -> DataFrame:
    return scoring.detect_language(comments(t)).select("doc_id", "detected_language", "language_score", "runner_up_score", "language_status")
