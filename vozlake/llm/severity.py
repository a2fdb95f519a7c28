"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered 0..K. The model has one weight per feature, shared by all thresholds:
P(grade > k) = sigmoid(w.x - theta_k) with theta_0 <= theta_1 <= ...; expected severity is the sum of these over k.
Features of a text are the distinct words it has and their first four, five and six bytes (which catches inflected and compound
forms), each by its 64-bit hash, so unseen words never share a weight.

Fitting uses a bounded sample: the ``MAX_LABELLED`` labelled rows with the smallest hash of their key. Features are counted over
that sample in Spark; the ``MAX_FEATURES`` with the largest chi-square against "grade above 0" get a weight, and the weights are
fitted on the driver from the sample's selected features only. Every document is scored, whole.

Rows: a null text has no features; labels with a null key or grade are not used; repeated labels count each time; grades that the
sample lacks get no threshold; with one grade only (or no labels) every document has that grade's (or zero) severity; keys may
repeat or be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vozlake.durable import cut
from vozlake.llm import textscan as ts

#: labelled rows used to fit
MAX_LABELLED = 12_000
#: features with a weight
MAX_FEATURES = 4_096
#: labelled texts a feature must occur in
MIN_TEXTS = 3
PREFIXES = (4, 5, 6)
_PENALTY = 0.02
_STEPS = 400


def features(chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) for each word and its beginnings; repeats are left in."""
    words = ts.words(chunk, ts.ALNUM, folded=True)
    doc, found = [words.doc], [words.hashes]
    length = words.ends - words.starts
    for k in PREFIXES:
        at = np.flatnonzero(length > k)
        doc.append(words.doc[at])
        found.append(ts.mix(ts.span_hashes(chunk.data, words.starts[at], words.starts[at] + k, folded=True) + np.uint64(k)))
    return np.concatenate(doc), np.concatenate(found)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    grades: np.ndarray  # the ordered grades seen, thresholds lie between them
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k + 1]) by row and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))

    def severity(self, probabilities: np.ndarray) -> np.ndarray:
        return self.grades[0] + probabilities @ np.diff(self.grades)

    def scores(self, chunk: ts.Chunk) -> np.ndarray:
        if not len(self.features):
            return np.zeros(chunk.count)
        doc, found = features(chunk)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        hit = self.features[at] == found
        pairs = np.unique(doc[hit] * len(self.features) + at[hit])
        return np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], minlength=chunk.count)


def fit_weights(rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, grades and thresholds by gradient steps on the penalised log-likelihood of presence features.

    Thresholds are the first one plus positive gaps, so they stay in order."""
    grades, y = np.unique(grade, return_inverse=True)
    k = len(grades) - 1
    if k < 1:
        return np.zeros(size), grades.astype(float), np.zeros(0)
    n = len(y)
    above = np.array([(y > j).mean() for j in range(k)])
    theta = np.log((1 - above) / above)
    free = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    w = np.zeros(size)
    moment, square = [np.zeros(size + k) for _ in range(2)]
    for step in range(1, _STEPS + 1):
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, w[columns], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - np.concatenate([[-np.inf], theta, [np.inf]])[None, :], -500, 500)))
        upper, lower = p[np.arange(n), y], p[np.arange(n), y + 1]
        share = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / share, lower * (1 - lower) / share
        by_score = -(du - dl) / n
        slope = np.zeros(k + 2)
        np.add.at(slope, y, du / n)
        np.add.at(slope, y + 1, -dl / n)
        by_theta = slope[1:-1]
        tail = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([
            np.bincount(columns, by_score[rows], minlength=size) + _PENALTY * w / n ** 0.5, [tail[0]], tail[1:] * gaps])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        move = 0.05 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        w, free = w - move[:size], free - move[size:]
    return w, grades.astype(float), free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, labels: DataFrame, grade: Column, key: str = "doc_id", text: str = "text",
        max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    ts.bounded_batches(docs.sparkSession)
    usable = labels.select(F.col(key).alias("_key"), grade.cast("int").alias("grade")).filter(
        F.col("_key").isNotNull() & F.col("grade").isNotNull())
    # at most max_labelled rows, so it may be broadcast
    chosen = usable.orderBy(F.xxhash64("_key"), "_key", "grade").limit(max_labelled)
    sample = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_key")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(0)):
                doc, found = features(chunk)
                order = np.lexsort((found, doc))
                doc, found = doc[order], found[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])]) if len(doc) else np.zeros(0, bool)
                doc, found = doc[new], found[new]
                ends = np.searchsorted(doc, np.arange(chunk.count + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(chunk.first, chunk.count),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64))),
                    batch.column(2).slice(chunk.first, chunk.count), batch.column(3).slice(chunk.first, chunk.count),
                ], ["grade", "features", "_h", "_d"])

    digests = F.xxhash64("_key"), F.xxhash64("_text")
    kept_columns = sample.select("_text", "grade", digests[0].alias("_h"), digests[1].alias("_d"))
    stored = cut(kept_columns.mapInArrow(gather, "grade int, features array<long>, _h long, _d long"), "labelled")
    if stored.count() > max_labelled:  # labelled keys with several rows
        stored = cut(stored.orderBy("_h", "_d", "grade").limit(max_labelled), "labelled")
    totals = stored.agg(F.count(F.lit(1)), F.count(F.when(F.col("grade") > 0, 1))).first()
    n, positive = totals[0], totals[1]
    counted = stored.select(F.explode("features").alias("feature"), (F.col("grade") > 0).cast("int").alias("_p")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_a")).filter(F.col("_n") >= MIN_TEXTS)
    off = F.col("_a") * float(n) - F.col("_n") * float(positive)
    counted = counted.filter(F.col("_n") < n).withColumn("_chi", off * off / (F.col("_n") * (float(n) - F.col("_n"))))
    rows = counted.orderBy(F.col("_chi").desc(), "feature").limit(max_features).select("feature").collect()
    kept = np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            found = lists.flatten().to_numpy().view(np.uint64)
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(kept, found), max(len(kept) - 1, 0))
            hit = kept[at] == found if len(kept) else np.zeros(len(found), bool)
            ends = np.searchsorted(doc[hit], np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))], ["grade", "at"])

    got = stored.select("grade", "features").mapInArrow(select, "grade int, at array<int>").toArrow()  # at most max_labelled rows of a few features
    lists = got.column("at").combine_chunks()
    order = _stable_order(got)
    lengths = np.diff(lists.offsets.to_numpy())
    begins = lists.offsets.to_numpy()[:-1]
    columns = lists.values.to_numpy()[ts.slices(begins[order], lengths[order])]
    y = got.column("grade").to_numpy()[order]
    weights, grades, thresholds = fit_weights(np.repeat(np.arange(len(y)), lengths[order]), columns, y, len(kept))
    if not len(grades):
        grades = np.zeros(1)
    return Model(kept, weights, grades, thresholds)


def _stable_order(table: pa.Table) -> np.ndarray:
    """An order that doesn't depend on how tasks finished, so that a fit gives the same sums each time."""
    keys = [(g, tuple(a)) for g, a in zip(table.column("grade").to_pylist(), table.column("at").to_pylist())]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with expected_severity, p_toxic (chance of any grade above the lowest) and grade (the largest grade
    that is reached with a chance of a half or more)."""
    ts.bounded_batches(docs.sparkSession)
    kept = docs.select(*keep)
    schema = ", ".join(f"{ts.quoted(c)} {t}" for c, t in kept.dtypes) + ", expected_severity double, p_toxic double, grade int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(len(keep))):
                p = model.probabilities(model.scores(chunk))
                reached = (p >= 0.5).sum(axis=1)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(chunk.first, chunk.count) for i in range(len(keep))),
                    pa.array(np.round(model.severity(p), 9)),
                    pa.array(np.round(p[:, 0], 9) if p.shape[1] else np.zeros(chunk.count)),
                    pa.array(model.grades[reached].astype(np.int32)),
                ], [*keep, "expected_severity", "p_toxic", "grade"])

    return docs.select(*keep, F.col(text).cast("string").alias("_scored_text")).mapInArrow(run, schema)


def label_grade() -> Column:
    """0 for not toxic, 1 for toxic, 2 for toxic and of low quality."""
    toxic = F.col("toxic").cast("int")
    return toxic * F.when(F.col("quality").cast("int") == 0, 2).otherwise(1)
