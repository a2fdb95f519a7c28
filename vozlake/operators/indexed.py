"""Scoring with a frozen coefficient table of thousands of features, through an index of its terms.

Tokens are found in the JVM. In the task, Arrow looks each token up in the table's words, neighbours are looked up as one
number made of both words' places, and the weights of the hits are summed by comment in numpy. No feature is a literal
in the plan, so a plan's size does not depend on the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.functions import text as tx
from vozlake.operators import scoring


@dataclass(frozen=True)
class FeatureIndex:
    """Features by place (in their own order), their idf, and the numbers that find them."""

    words: pa.Array
    single: np.ndarray  # place of the feature that is this word alone, or -1
    pairs: np.ndarray  # ascending first * len(words) + second
    pair_places: np.ndarray
    idf: np.ndarray

    @classmethod
    def of(cls, features: list[tuple[str, float]]) -> "FeatureIndex":
        split = [f.split(" ") for f, _ in features]
        words = sorted({w for parts in split for w in parts})
        number = {w: i for i, w in enumerate(words)}
        single = np.full(len(words) + 1, -1, dtype=np.int64)  # one more for words that are not known
        pairs = []
        for place, parts in enumerate(split):
            if len(parts) == 1:
                single[number[parts[0]]] = place
            else:
                pairs.append((number[parts[0]] * len(words) + number[parts[1]], place))
        pairs.sort()
        return cls(pa.array(words, pa.string()), single, np.array([p for p, _ in pairs], dtype=np.int64),
                   np.array([p for _, p in pairs], dtype=np.int64), np.array([i for _, i in features], dtype=float))

    def entries(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row, feature, normalised tf-idf) of a list column of tokens, by row and feature, and how many rows there are."""
        rows = len(tokens)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(rows), lengths)
        size = len(self.words)
        met = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.words), size).to_numpy(zero_copy_only=False).astype(np.int64)
        hits = self.single[met]
        found = [row[hits >= 0] * len(self.idf) + hits[hits >= 0]]
        if len(self.pairs):
            both = np.flatnonzero((row[1:] == row[:-1]) & (met[1:] < size) & (met[:-1] < size))
            code = met[both] * size + met[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            known = self.pairs[at] == code
            found.append(row[both[known]] * len(self.idf) + self.pair_places[at[known]])
        cell, tf = np.unique(np.concatenate(found), return_counts=True)
        row, feature = np.divmod(cell, max(len(self.idf), 1))
        x = tf * self.idf[feature]
        norm = np.sqrt(np.bincount(row, x * x, minlength=rows))
        return row, feature, x / norm[row], rows


def frozen(table: DataFrame, limit: int = C.TFIDF_MAX_FEATURES) -> tuple[FeatureIndex, np.ndarray, np.ndarray]:
    """Index, weights and intercepts of a coefficient table; refuses one above its fixed size."""
    names = [f"w_{c.lower()}" for c in C.CLASSES]
    found = table.select("feature", "idf", *names).limit(limit + 2).collect()
    if len(found) > limit + 1:
        raise ValueError(f"coefficient table exceeds {limit} features")
    features = sorted(tuple(r) for r in found if r.feature != "")
    base = [r for r in found if r.feature == ""]
    weights = np.array([r[2:] for r in features], dtype=float).reshape(-1, len(names))
    intercepts = np.array(base[0][2:], dtype=float) if base else np.zeros(len(names))
    return FeatureIndex.of([r[:2] for r in features]), weights, intercepts


def scorer(table: DataFrame, limit: int = C.TFIDF_MAX_FEATURES) -> Callable[[pa.Array], pa.Array]:
    """From a list column of tokens to struct<n int, p array<double>>."""
    index, weights, intercepts = frozen(table, limit)

    def run(tokens: pa.Array) -> pa.Array:
        row, feature, x, rows = index.entries(tokens)
        z = np.stack([np.bincount(row, x * weights[feature, k], minlength=rows) for k in range(len(intercepts))], axis=1) + intercepts
        e = np.exp(z - z.max(axis=1, keepdims=True)) if rows else z
        p = e / e.sum(axis=1, keepdims=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(intercepts), pa.int32()), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.bincount(row, minlength=rows), pa.int32()), lists], ["n", "p"])

    return run


def score(df: DataFrame, table: DataFrame, text_col: str = "text", limit: int = C.TFIDF_MAX_FEATURES) -> DataFrame:
    """Append ``scoring.SCORE_COLUMNS`` to prepared comments, by a frozen coefficient table."""
    run = scorer(table, limit)

    @F.arrow_udf("struct<n:int,p:array<double>>")
    def probabilities(tokens: pa.Array) -> pa.Array:
        return run(tokens)

    found = df.withColumn("_p", probabilities(tx.model_tokens(F.col(text_col))))
    ranked = F.inline_outer(F.array(scoring.result(F.col("_p.p"), F.col("_p.n"))))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], ranked)
