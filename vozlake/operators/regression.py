"""Balanced multinomial regression for all folds and penalties at once, and a certificate that a table is its optimum.

Comments become sparse rows once (stored). Each pass over them gives the losses and gradients of every model, for the points
that the models ask about; sums are made in the tasks, then by stretches of the parameters, and the driver holds parameters
only, whose number is bounded. The models step in common: each has its own quasi-Newton memory and step length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions import text as tx
from vozlake.operators.indexed import FeatureIndex

K = len(C.CLASSES)
#: largest entry of the mean gradient at which a model is done, and passes after which it is left as it is
TOLERANCE, MAX_PASSES = 1e-6, 200
#: non-zero entries handled at once, and parameters of a stretch
_ENTRIES, _STRETCH = 1 << 16, 1 << 14
_MEMORY = 40


@dataclass
class _Model:
    """One penalty on all rows but those of one fold (-1: all rows); a minimum by limited-memory quasi-Newton steps, scaled by the
    root of each parameter's curvature at the start (the whole curvature oversteps where features go together)."""

    fold: int
    strength: float
    point: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    step: float = 1.0
    direction: np.ndarray | None = None
    scale: np.ndarray | float = 1.0
    memory: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    def asked(self) -> np.ndarray:
        return self.point if self.direction is None else self.point + self.step * self.direction

    def told(self, loss: float, gradient: np.ndarray) -> None:
        if self.done:
            return
        at = self.asked()
        if self.direction is not None:
            slope = float(self.gradient @ self.direction)
            if loss > self.loss + 1e-4 * self.step * slope and self.step > 1e-10:
                self.step /= 2
                return
            moved, turned = at - self.point, gradient - self.gradient
            if moved @ turned > 0:
                self.memory = [*self.memory[1 - _MEMORY:], (moved, turned)]
        self.point, self.loss, self.gradient, self.step = at, loss, gradient, 1.0
        self.done = float(np.abs(gradient).max()) < TOLERANCE
        self.direction = self._towards(gradient)

    def _towards(self, gradient: np.ndarray) -> np.ndarray:
        q, steps = gradient.copy(), []
        for s, y in reversed(self.memory):
            a = (s @ q) / (s @ y)
            q -= a * y
            steps.append(a)
        if self.memory:
            s, y = self.memory[-1]
            q *= (s @ y) / (y @ (y / self.scale))
        q /= self.scale
        for (s, y), a in zip(self.memory, reversed(steps)):
            q += s * (a - (y @ q) / (s @ y))
        return -q


def rows_of(df: DataFrame, index: FeatureIndex, text_col: str, label_col: str, key: Column, folds: int) -> DataFrame:
    """Stored stage: fold (a digest bucket of the key), label, and the places and normalised values of the features of each comment."""
    label = F.array_position(F.array(*map(F.lit, C.CLASSES)), F.col(label_col)).cast("int") - 1
    given = df.filter(F.col(label_col).isin(list(C.CLASSES))).select(
        F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"), label.alias("label"), tx.model_tokens(F.col(text_col)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, x, _ = index.entries(batch.column(2))
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(v, t)) for v, t in ((feature, pa.int32()), (x, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["fold", "label", "feature", "x"])

    return cut(given.mapInArrow(run, "fold int, label int, feature array<int>, x array<double>"), "vectors")


def _pass(rows: DataFrame, models: Sequence[_Model], weights: np.ndarray, features: int, squares: bool = False) -> tuple[np.ndarray, ...]:
    """Summed losses and gradients of all models, how many rows of their own fold they have right and, if asked for, the weighted
    sums of squares of each feature."""
    m, folds = len(models), np.array([model.fold for model in models])
    points = np.stack([model.asked().reshape(features + 1, K) for model in models], axis=0).transpose(0, 2, 1).reshape(m * K, features + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, loss, right = np.zeros_like(points), np.zeros(m), np.zeros(m)
        square = np.zeros((m if squares else 0, features + 1))
        for batch in batches:
            fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begin = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            feature, x = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            low = 0
            while low < batch.num_rows:
                high = max(int(np.searchsorted(begin, begin[low] + _ENTRIES, side="right")) - 1, low + 1)
                n, y = high - low, np.arange(high - low)
                row = np.repeat(y, np.diff(begin[low:high + 1]))
                at, value = feature[begin[low]:begin[high]], x[begin[low]:begin[high]]
                # the last parameter of a class is its intercept
                z = np.stack([np.bincount(row, value * w[at], minlength=n) + w[features] for w in points], axis=1).reshape(n, m, K)
                z -= z.max(axis=2, keepdims=True)
                p = np.exp(z)
                total = p.sum(axis=2, keepdims=True)
                own = label[low:high]
                held = fold[low:high, None] == folds
                s = np.where(held, 0.0, weights[:, own].T)
                loss += (s * (np.log(total[:, :, 0]) - z[y, :, own])).sum(axis=0)
                right += (held & (z.argmax(axis=2) == own[:, None])).sum(axis=0)
                p /= total
                p[y, :, own] -= 1
                rest = np.ascontiguousarray((s[:, :, None] * p).reshape(n, m * K).T)
                for sums, r in zip(gradient, rest):
                    sums[:features] += np.bincount(at, value * r[row], minlength=features)
                    sums[features] += r.sum()
                for sums, r in zip(square, s.T):
                    sums[:features] += np.bincount(at, value * value * r[row], minlength=features)
                    sums[features] += r.sum()
                low = high
        flat = np.concatenate([gradient.ravel(), loss, right, square.ravel()])
        parts = [flat[a:a + _STRETCH] for a in range(0, len(flat), _STRETCH)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([v.tobytes() for v in parts], pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part."""
        now, total = None, None
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(raw.as_buffer())
                if part != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])
                    now, total = part, np.zeros(len(values))
                total += values
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    schema = "part int, sums binary"
    summed = rows.mapInArrow(run, schema).repartition("part").sortWithinPartitions("part").mapInArrow(add, schema)
    got = sorted((r.part, bytes(r.sums)) for r in summed.collect())
    flat = np.frombuffer(b"".join(v for _, v in got)) if got else np.zeros(points.size + 2 * m + (m * (features + 1) if squares else 0))
    gradients, losses, right, square = np.split(flat, np.cumsum([points.size, m, m]))
    return losses, gradients.reshape(m, K, features + 1).transpose(0, 2, 1), right, square.reshape(-1, features + 1)


@dataclass(frozen=True)
class Fit:
    """Weights of the chosen penalty on all rows (features, then intercepts), and for each penalty and fold the cases and hits."""

    strength: float
    weights: np.ndarray
    choices: list[tuple[float, int, int, int]]
    passes: int


def fit(rows: DataFrame, features: int, strengths: Sequence[float], folds: int) -> Fit:
    """``rows`` as of :func:`rows_of`. Of several strengths that with the most hits on held-out folds is chosen (ties: the first)."""
    counts = np.zeros((max(folds, 1), K))
    for r in rows.groupBy("fold", "label").count().collect():  # folds times classes
        counts[r.fold, r.label] = r["count"]
    held = range(folds) if folds > 1 and len(strengths) > 1 else ()
    models = [_Model(f, s, np.zeros((features + 1) * K)) for f in (*held, -1) for s in strengths]
    sizes = np.stack([counts.sum(axis=0) - (counts[m.fold] if m.fold >= 0 else 0) for m in models])
    n = np.maximum(sizes.sum(axis=1), 1)
    weights = n[:, None] / (K * np.maximum(sizes, 1))
    right, passes = np.zeros(len(models)), 0
    while passes < MAX_PASSES and not all(m.done for m in models):
        losses, gradients, right, square = _pass(rows, models, weights, features, squares=not passes)
        passes += 1
        for i, model in enumerate(models):
            pull = model.asked().reshape(features + 1, K) / (model.strength * n[i])
            pull[-1] = 0  # intercepts are free
            penalty = 0.5 * float((pull * model.asked().reshape(features + 1, K)).sum())
            if passes == 1:
                # all classes are alike at the start
                bend = square[i] * (K - 1) / (K * K * n[i]) + 1 / (model.strength * n[i])
                model.scale = np.repeat(np.sqrt(bend), K)
            model.told(losses[i] / n[i] + penalty, (gradients[i] / n[i] + pull).ravel())
    if held:
        right = _pass(rows, [_at(m) for m in models], weights, features)[2]
    choices = [(m.strength, m.fold, int(counts[m.fold].sum()), int(right[i])) for i, m in enumerate(models) if m.fold >= 0]
    hits = [sum(c[3] for c in choices if c[0] == s) for s in strengths]
    best = strengths[hits.index(max(hits))]
    final = next(m for m in models if m.fold < 0 and m.strength == best)
    return Fit(best, final.point.reshape(features + 1, K), choices, passes)


def _at(model: _Model) -> _Model:
    return _Model(model.fold, model.strength, model.point)


def certificate(df: DataFrame, table: DataFrame, key_col: str, text_col: str = "text", label_col: str = "expected",
                inverse_strength: float = 1.0) -> DataFrame:
    """Per class: cases, class_weight, mean_probability and the largest entry of the penalised mean gradient at the table's weights.

    Worked out from the text with joins and sums alone. At the optimum the gradient is zero, so the weighted mean probability of a
    class is its weighted share. The table is bounded (TFIDF_MAX_FEATURES), and so is its broadcast."""
    names = [f"w_{c.lower()}" for c in C.CLASSES]
    base = table.filter("feature = ''").select(*[F.col(w).alias(f"b{k}") for k, w in enumerate(names)])
    cases = df.filter(F.col(label_col).isin(list(C.CLASSES))).select(F.col(key_col).alias("key"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    sizes = cases.groupBy("label").agg(F.count(F.lit(1)).alias("cases"))
    n = cases.agg(F.count(F.lit(1))).scalar()
    counted = tx.run_lengths(F.sort_array(tx.with_bigrams(tx.model_tokens(F.col("text")))), "feature", "tf")
    terms = cases.select("key", F.inline(counted)).join(F.broadcast(table.filter("feature <> ''")), "feature").withColumn("x", F.col("tf") * F.col("idf"))
    sums = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *[F.sum(F.col("x") * F.col(w)).alias(f"d{k}") for k, w in enumerate(names)])
    z = [F.col(f"b{k}") + F.coalesce(F.col(f"d{k}") / F.col("norm"), F.lit(0.0)) for k in range(K)]
    scored = cases.select("key", "label").join(sums, "key", "left").join(F.broadcast(base)).join(F.broadcast(sizes), "label")
    scored = scored.select("key", "label", "norm", (n / (K * F.col("cases"))).alias("s"), *[zk.alias(f"z{k}") for k, zk in enumerate(z)])
    top = F.greatest(*[F.col(f"z{k}") for k in range(K)])
    scored = scored.select("key", "label", "norm", "s", *[F.exp(F.col(f"z{k}") - top).alias(f"e{k}") for k in range(K)])
    total = sum((F.col(f"e{k}") for k in range(1, K)), F.col("e0"))
    scored = cut(scored.select("key", "label", "norm", "s", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in range(K)]), "certificate")
    rest = [(F.col("s") * (F.col(f"p{k}") - (F.col("label") == c).cast("double"))).alias(f"r{k}") for k, c in enumerate(C.CLASSES)]
    pulled = terms.select("key", "feature", "x", *names).join(scored.select("key", "norm", *rest), "key")
    by_feature = pulled.groupBy("feature").agg(
        *[F.sum(F.col(f"r{k}") * F.col("x") / F.col("norm")).alias(f"g{k}") for k in range(K)], *[F.any_value(w).alias(w) for w in names])
    # a feature that no comment has is pulled by its penalty alone
    by_feature = table.filter("feature <> ''").select("feature", *names).join(by_feature.drop(*names), "feature", "left")
    steep = by_feature.agg(*[F.max(F.abs(F.coalesce(F.col(f"g{k}") / n, F.lit(0.0)) + F.col(w) / (inverse_strength * n))).alias(f"h{k}") for k, w in enumerate(names)])
    means = scored.agg(*[(F.sum(F.col("s") * F.col(f"p{k}")) / n).alias(f"m{k}") for k in range(K)])
    wide = means.join(F.broadcast(steep))
    free = [F.abs(F.col(f"m{k}") - 1.0 / K) for k in range(K)]
    per_class = wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("class"), F.col(f"m{k}").alias("mean_probability"), F.greatest(F.col(f"h{k}"), free[k]).alias("largest_gradient"))
        for k, c in enumerate(C.CLASSES)])))
    return per_class.join(F.broadcast(sizes), F.col("class") == F.col("label")).select(
        "class", "cases", (n / (K * F.col("cases"))).alias("class_weight"), "mean_probability", "largest_gradient")
