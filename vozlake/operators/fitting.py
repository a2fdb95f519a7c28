"""Fitting jobs: tf-idf vocabulary, logistic regression, language profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions import text as tx
from vozlake.operators import ranking, regression, terms
from vozlake.operators.indexed import FeatureIndex
from vozlake.operators.scoring import MODEL_SCHEMA


def model_terms(text: Column) -> Column:
    return tx.with_bigrams(tx.model_tokens(text))


def term_counts(df: DataFrame, keep: Sequence[str], terms: Column) -> DataFrame:
    """(keep..., feature, tf): each comment counts its own terms before any shuffle."""
    counted = tx.run_lengths(F.sort_array(terms), "feature", "tf")
    return df.select(*keep, F.inline_outer(counted)).filter(F.col("feature").isNotNull())


def fit_tfidf(df: DataFrame, text_col: str = "text", min_df: int = C.TFIDF_MIN_DF,
              max_df: float = C.TFIDF_MAX_DF, max_features: int = C.TFIDF_MAX_FEATURES) -> DataFrame:
    """Vocabulary table: feature, df, corpus_count, idf (smooth, plus one).

    The document frequency of the empty feature is the number of comments, so
    the text is read once.
    """
    counts = cut(terms.partial_counts(df, tx.model_tokens(F.col(text_col))).groupBy("feature").agg(
        F.sum("df").alias("df"), F.sum("tf").alias("corpus_count")))
    sized = counts.filter("feature <> ''").withColumn("_n", counts.filter("feature = ''").select(F.max("df")).scalar())
    kept = sized.filter((F.col("df") >= min_df) & (F.col("df") <= F.col("_n") * max_df))
    best = kept.orderBy(F.col("corpus_count").desc(), F.col("feature").asc()).limit(max_features)
    idf = F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + 1.0
    return best.select("feature", "df", "corpus_count", F.round(idf, 9).alias("idf"))


def _entries(vocabulary: DataFrame, limit: int) -> list[tuple[str, float]]:
    rows = vocabulary.select("feature", "idf").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"vocabulary exceeds {limit} features")
    return sorted((r.feature, float(r.idf)) for r in rows)


def fit_logreg(df: DataFrame, vocabulary: DataFrame, text_col: str = "text", label_col: str = "expected",
               inverse_strength: float = 1.0, folds: int | None = None,
               grid: Sequence[float] = (0.1, 1.0, 10.0),
               limit: int = C.TFIDF_MAX_FEATURES, key_col: str | None = None) -> DataFrame:
    """Balanced multinomial regression; returns a coefficient table.

    ``folds`` chooses the inverse strength from ``grid`` by cross-validated
    accuracy; a comment's fold is a digest bucket of its key (or text). The fitted
    table has one row per feature plus the intercept row.
    """
    entries = _entries(vocabulary, limit)
    rows = regression.rows_of(df, FeatureIndex.of(entries), text_col, label_col, F.col(key_col or text_col), folds or 1)
    weights = regression.fit(rows, len(entries), tuple(grid) if folds else (inverse_strength,), folds or 1).weights
    table = [("", 0.0, *map(float, weights[-1]))]
    table += [(f, i, *map(float, weights[k])) for k, (f, i) in enumerate(entries)]
    return df.sparkSession.createDataFrame(table, MODEL_SCHEMA)


def fit_ratio(df: DataFrame, vocabulary: DataFrame, text_col: str = "text", label_col: str = "expected") -> DataFrame:
    """A coefficient table in closed form: log ratio of a term's share inside a class to its share outside, added-one, in one pass."""
    labelled = df.filter(F.col(label_col).isin(list(C.CLASSES)))
    mine = lambda c: F.sum(F.when(F.col(label_col) == c, F.col("tf")).otherwise(0))
    names = [c.lower() for c in C.CLASSES]
    # at most TFIDF_MAX_FEATURES rows, so no other term is shuffled
    known = F.broadcast(cut(vocabulary.select("feature", "idf"), "vocabulary"))
    counts = terms.partial_counts(labelled, tx.model_tokens(F.col(text_col)), [label_col]).join(known, "feature", "left_semi")
    per = cut(counts.groupBy("feature").agg(*[mine(c).alias(f"n_{k}") for c, k in zip(C.CLASSES, names)]).join(known, "feature"), "ratios")
    every = sum((F.col(f"n_{k}") for k in names[1:]), F.col(f"n_{names[0]}"))
    totals = per.agg(F.count(F.lit(1)).alias("_v"), F.sum(every).alias("_n"), *[F.sum(f"n_{k}").alias(f"_n_{k}") for k in names])

    def weight(k: str) -> Column:
        inside = (F.col(f"n_{k}") + 1.0) / (F.col(f"_n_{k}") + F.col("_v"))
        outside = (every - F.col(f"n_{k}") + 1.0) / (F.col("_n") - F.col(f"_n_{k}") + F.col("_v"))
        return F.round(F.log(inside / outside), 6).alias(f"w_{k}")

    table = per.join(F.broadcast(totals)).select("feature", "idf", *[weight(k) for k in names])
    base = df.sparkSession.createDataFrame([("", 0.0, *[0.0] * len(names))], MODEL_SCHEMA)
    return base.unionByName(table)


def language_weights(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 3) -> DataFrame:
    """(lang, word, count, weight): log ratio of a word inside a language to outside it."""
    tokens = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(tx.WORD_CLASS + "+"), F.lit(0))
    # four readers follow, so the counts are stored instead of the text being tokenised again
    per = cut(term_counts(df, [lang_col], tokens).groupBy(lang_col, "feature").agg(F.sum("tf").alias("count")))
    words = per.groupBy("feature").agg(F.sum("count").alias("_word"))
    langs = per.groupBy(lang_col).agg(F.sum("count").alias("_lang"))
    distinct = words.agg(F.count(F.lit(1)).alias("v"), F.sum("_word").alias("n"))
    sized = (
        per.filter(F.col("count") >= min_count)
        .join(words, "feature").join(langs, lang_col)
        .withColumn("_v", distinct.select("v").scalar()).withColumn("_n", distinct.select("n").scalar())
    )
    inside = (F.col("count") + 1.0) / (F.col("_lang") + F.col("_v"))
    outside = (F.col("_word") - F.col("count") + 1.0) / (F.col("_n") - F.col("_lang") + F.col("_v"))
    return sized.select(F.col(lang_col).alias("lang"), F.col("feature").alias("word"), "count",
                        F.round(F.log(inside / outside), 6).alias("weight"))


def fit_language_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
                          top: int = 200, min_count: int = 3) -> DataFrame:
    """The ``top`` most telling words per language."""
    weights = language_weights(df, text_col, lang_col, min_count)
    return ranking.first_per_group(weights, ["lang"], [F.col("weight").desc(), F.col("word").asc()], top)


def extreme_coefficients(weights: DataFrame, class_col: str, feature_col: str, weight_col: str = "weight",
                         count: int = 25) -> DataFrame:
    """Highest and lowest weighted features per class."""
    def side(name: str, order) -> DataFrame:
        ranked = ranking.first_per_group(weights, [class_col], [order, F.col(feature_col).asc()], count)
        return ranked.select(class_col, F.lit(name).alias("side"), "rank", feature_col, weight_col)

    return side("highest", F.col(weight_col).desc()).unionByName(side("lowest", F.col(weight_col).asc()))


def coefficients_long(table: DataFrame) -> DataFrame:
    """A coefficient table as (class, feature, weight)."""
    return table.filter("feature <> ''").select("feature", F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"w_{c.lower()}").alias("weight")) for c in C.CLASSES])))


def term_coefficients(weights: DataFrame, terms: Sequence[str], class_col: str, feature_col: str,
                      classes: Sequence[str], weight_col: str = "weight") -> DataFrame:
    """One row per asked term, one column per class, null where absent."""
    wanted = weights.filter(F.col(feature_col).isin(list(terms)))
    wide = wanted.groupBy(F.col(feature_col).alias("term")).agg(*[
        F.max(F.when(F.col(class_col) == c, F.col(weight_col))).alias(c) for c in classes])
    listed = weights.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
    return F.broadcast(listed).join(wide, "term", "left")
