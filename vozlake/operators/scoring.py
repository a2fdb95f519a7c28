"""Linear text scoring and language detection as row-local expressions.

A comment is tokenised, matched and scored inside one generated row: no shuffle,
no join, and the original columns stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vozlake import constants as C
from vozlake.functions import text as tx
from vozlake.functions.lookup import TermTable, doubles
from vozlake.operators import lexicon

MODEL_SCHEMA = "feature string, idf double, w_negativo double, w_neutro double, w_positivo double"
PROFILE_SCHEMA = "lang string, word string, weight double"
SCORE_COLUMNS = (
    "sentiment", "confidence", "probability_negativo", "probability_neutro",
    "probability_positivo", "second_best_class", "second_best_probability",
    "prediction_margin", "n_features",
)


@dataclass(frozen=True)
class LinearModel:
    """Coefficients in class order; at most ``TFIDF_MAX_FEATURES`` features."""

    rows: tuple[tuple[str, float, float, float, float], ...]
    intercepts: tuple[float, float, float]

    @classmethod
    @cache
    def starter(cls) -> "LinearModel":
        return cls(lexicon.STARTER_MODEL, lexicon.STARTER_INTERCEPTS)

    @classmethod
    def from_table(cls, table: DataFrame, limit: int = C.TFIDF_MAX_FEATURES) -> "LinearModel":
        """Read a frozen coefficient table; refuses one above its fixed size."""
        found = table.select("feature", "idf", "w_negativo", "w_neutro", "w_positivo").limit(limit + 2).collect()
        if len(found) > limit + 1:
            raise ValueError(f"coefficient table exceeds {limit} features")
        features = sorted(tuple(r) for r in found if r.feature != "")
        base = [r for r in found if r.feature == ""]
        intercepts = tuple(base[0][2:5]) if base else (0.0, 0.0, 0.0)
        return cls(tuple(features), intercepts)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [("", 0.0, *self.intercepts), *self.rows]
        return spark.createDataFrame(rows, MODEL_SCHEMA)

    @cached_property
    def terms(self) -> TermTable:
        return TermTable([r[0] for r in self.rows])

    def score(self, text: Column) -> Column:
        """struct with ``SCORE_COLUMNS`` for one prepared comment."""
        idf = doubles([r[1] for r in self.rows])
        weights = [doubles([r[2 + k] for r in self.rows]) for k in range(3)]
        names = ("a", "b", "c")
        zero = F.struct(F.lit(0.0).alias("q"), F.lit(0).alias("n"), *[F.lit(0.0).alias(k) for k in names])

        def step(acc: Column, term: Column) -> Column:
            x = term["tf"] * F.get(idf, term["i"])
            return tx.let(
                x,
                lambda v: F.struct(
                    (acc["q"] + v * v).alias("q"),
                    (acc["n"] + 1).alias("n"),
                    *[(acc[k] + v * F.get(w, term["i"])).alias(k) for k, w in zip(names, weights)],
                ),
            )

        def logits(acc: Column) -> Column:
            norm = F.when(acc["q"] > 0, F.sqrt(acc["q"])).otherwise(F.lit(1.0))
            return F.struct(
                acc["n"].alias("n"),
                *[(F.lit(b) + acc[k] / norm).alias(k) for k, b in zip(names, self.intercepts)],
            )

        def softmax(z: Column) -> Column:
            top = F.greatest(*[z[k] for k in names])
            return F.struct(z["n"].alias("n"), *[F.exp(z[k] - top).alias(k) for k in names])

        def divided(e: Column) -> Column:
            total = e["a"] + e["b"] + e["c"]
            probabilities = F.array(*[e[k] / total for k in names])
            return tx.let(probabilities, lambda p: result(p, e["n"]))

        counted = self.terms.counts(tx.with_bigrams(tx.model_tokens(text)))
        return tx.let(
            F.aggregate(counted, zero, step),
            lambda acc: tx.let(logits(acc), lambda z: tx.let(softmax(z), divided)),
        )


def ranked_classes(probabilities: Column) -> Column:
    """Classes by falling probability; equal ones stay in class order."""
    entries = F.array(*[
        F.struct((-F.get(probabilities, F.lit(k))).alias("neg"), F.lit(k).alias("k"), F.lit(c).alias("name"))
        for k, c in enumerate(C.CLASSES)
    ])
    return F.sort_array(entries)


def result(p: Column, n_features: Column) -> Column:
    """struct with ``SCORE_COLUMNS`` of the class probabilities in class order."""

    def build(ranked: Column) -> Column:
        first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        return F.struct(
            first["name"].alias("sentiment"),
            (-first["neg"]).alias("confidence"),
            *[F.get(p, F.lit(k)).alias(f"probability_{c.lower()}") for k, c in enumerate(C.CLASSES)],
            second["name"].alias("second_best_class"),
            (-second["neg"]).alias("second_best_probability"),
            (second["neg"] - first["neg"]).alias("prediction_margin"),
            n_features.alias("n_features"),
        )

    return tx.let(ranked_classes(p), build)


def prepare(df: DataFrame, text_col: str = "text", refuse_long: bool = False) -> DataFrame:
    """Stripped text, rows of at least two characters, every other column kept.

    ``refuse_long`` also leaves out texts above the length limit; :func:`set_aside` has them.
    """
    prepared = df.withColumn(text_col, tx.prepared(F.col(text_col)))
    return prepared.filter(tx.reject_reason(F.col(text_col)).isNull() if refuse_long else tx.is_valid(F.col(text_col)))


def set_aside(df: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keep..., n_chars, reason): the rows that a batch job with ``refuse_long`` does not judge, and why."""
    text = tx.prepared(F.col(text_col))
    return df.select(*keep, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
                     tx.reject_reason(F.coalesce(text, F.lit(""))).alias("reason")).filter("reason IS NOT NULL")


def score(df: DataFrame, model: LinearModel | None = None, text_col: str = "text") -> DataFrame:
    """Append ``SCORE_COLUMNS`` to already prepared comments.

    ``inline_outer`` makes the score struct a generated row: it is evaluated once
    and no later filter on a score column can duplicate the work below it.
    """
    return df.select("*", F.inline_outer(F.array(_score_of(text_col, model or LinearModel.starter()))))


@tx.per_session
def _score_of(text_col: str, model: LinearModel) -> Column:
    return model.score(F.col(text_col))


@dataclass(frozen=True)
class LanguageProfiles:
    """Weighted profile words per language, languages in name order."""

    weights: tuple[tuple[str, tuple[tuple[str, float], ...]], ...]
    supported: tuple[str, ...] = tuple(C.SUPPORTED_LANGUAGES)

    @classmethod
    def starter(cls, supported: Sequence[str] | None = None) -> "LanguageProfiles":
        table = tuple(
            (lang, tuple((w, lexicon.STARTER_PROFILE_WEIGHT) for w in words.split()))
            for lang, words in sorted(lexicon.STARTER_PROFILES.items())
        )
        return cls(table, tuple(supported or C.SUPPORTED_LANGUAGES))

    @classmethod
    def from_table(cls, table: DataFrame, supported: Sequence[str] | None = None,
                   limit: int = 10_000) -> "LanguageProfiles":
        found = table.select("lang", "word", "weight").limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"language profile table exceeds {limit} rows")
        grouped: dict[str, list[tuple[str, float]]] = {}
        for row in sorted(tuple(r) for r in found):
            grouped.setdefault(row[0], []).append((row[1], row[2]))
        return cls(tuple((k, tuple(v)) for k, v in sorted(grouped.items())),
                   tuple(supported or C.SUPPORTED_LANGUAGES))

    @property
    def words(self) -> list[str]:
        return sorted({w for _, entries in self.weights for w, _ in entries})

    @cached_property
    def terms(self) -> TermTable:
        return TermTable(self.words)

    def detect(self, text: Column) -> Column:
        """struct<detected_language, language_score, runner_up_score, language_status>."""
        words, languages = self.words, [lang for lang, _ in self.weights]
        vectors = []
        for _, entries in self.weights:
            table = dict(entries)
            vectors.append(doubles([table.get(w, 0.0) for w in words]))
        names = [f"s{k}" for k in range(len(languages))]
        zero = F.struct(*[F.lit(0.0).alias(n) for n in names])

        def step(acc: Column, term: Column) -> Column:
            return F.struct(*[
                (acc[n] + term["tf"] * F.get(v, term["i"])).alias(n) for n, v in zip(names, vectors)
            ])

        def decide(acc: Column) -> Column:
            entries = F.sort_array(F.array(*[
                F.struct((-acc[n]).alias("neg"), F.lit(lang).alias("lang"))
                for n, lang in zip(names, languages)
            ]))
            return tx.let(entries, outcome)

        def outcome(ranked: Column) -> Column:
            best = F.get(ranked, F.lit(0))
            hit = best["neg"] < 0
            status = (
                F.when(~hit, "unknown")
                .when(best["lang"].isin(list(self.supported)), "detected")
                .otherwise("unsupported")
            )
            return F.struct(
                F.when(hit, best["lang"]).alias("detected_language"),
                (-best["neg"]).alias("language_score"),
                (-F.get(ranked, F.lit(1))["neg"]).alias("runner_up_score"),
                status.alias("language_status"),
            )

        tokens = F.regexp_extract_all(F.lower(text), F.lit(tx.WORD_CLASS + "+"), F.lit(0))
        return tx.let(F.aggregate(self.terms.counts(tokens), zero, step), decide)


def detect_language(df: DataFrame, profiles: LanguageProfiles | None = None,
                    text_col: str = "text") -> DataFrame:
    """Append detected_language, language_score, runner_up_score, language_status."""
    return df.select("*", F.inline_outer(F.array(_language_of(text_col, profiles or LanguageProfiles.starter()))))


@tx.per_session
def _language_of(text_col: str, profiles: LanguageProfiles) -> Column:
    return profiles.detect(F.col(text_col))
