"""Language of a text by a posterior over character trigrams.

A text is its words (runs of letters, lower-cased) with one blank between, before and after. Profiles are the trigrams that are
most frequent in some language, each with a smoothed log share per language; they are fitted from tagged texts, stored as a
bounded table and read back. A row's scores are sums over its trigrams, normalised to a posterior. The JVM finds the words; trigrams are
numbers of three code points, looked up in the task for a bounded stretch of the texts at once.

States: ``detected``; ``unsupported`` (best language not among the supported); ``unknown`` (``empty_text``: nothing but blanks;
``undetectable_text``: no trigram of the profiles); ``error`` (``detector_error``: the profiles give no number for a trigram).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.operators import ranking

#: most frequent trigrams of each language, and what is added to each count
TOP_GRAMS, SMOOTHING = 300, 0.5
MAX_ROWS = 50_000
#: trigrams drawn per run, on average, and the prime that draws count by
DRAWS, PRIME = 64, 1_000_003
#: code points whose trigrams a task holds at once, and counted trigrams that it holds before it sends them on
PIECE, HELD = 1 << 18, 1 << 18
COLUMNS = ("detected_language", "posterior", "runner_up_posterior", "language_status", "language_error")


def spelled(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


@dataclass(frozen=True)
class _Grams:
    """Trigrams of some texts: the row, place in the text and number of each, and how many each row has."""

    row: np.ndarray
    place: np.ndarray
    code: np.ndarray
    counts: np.ndarray


def _code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _gram(code: int) -> str:
    return "".join(chr(code >> shift & 0x1FFFFF) for shift in (42, 21, 0))


def _grams(texts: pa.Array) -> _Grams:
    values = [v or "" for v in texts.to_pylist()]
    points = np.frombuffer("".join(values).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    counts = np.maximum(lengths - 2, 0)
    row = np.repeat(np.arange(len(values)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(lengths) - lengths, counts) + place
    return _Grams(row, place, points[at] << 42 | points[at + 1] << 21 | points[at + 2] if len(at) else np.zeros(0, np.int64), counts)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, _Grams]]:
    """(number of the first text, trigrams) of stretches of about PIECE code points. A longer text is alone, a stretch of it after the other."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        before = int(ends[low - 1]) if low else 0
        high = max(int(np.searchsorted(ends, before + PIECE, side="right")), low + 1)
        size = int(ends[high - 1]) - before
        if size <= PIECE:
            yield low, _grams(texts.slice(low, high - low))
        else:
            text = texts[low].as_py()
            for at in range(0, size - 2, PIECE):
                found = _grams(pa.array([text[at:at + PIECE + 2]], pa.string()))
                yield low, _Grams(found.row, found.place + at, found.code, np.array([size - 2]))
        low = high


def _summed(lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal trigrams of a language as one."""
    order = np.lexsort((code, lang))
    lang, code = lang[order], code[order]
    first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)
    return lang[first], code[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def gram_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Stored stage: (lang, gram, count); a task sends a row per language and trigram, or more when it meets more than HELD of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            nonlocal held, size
            lang, code, n = _summed(*map(np.concatenate, zip(*held)))
            held, size, names = [], 0, pa.array(list(numbers), pa.string())
            numbers.clear()
            return pa.RecordBatch.from_arrays([names.take(pa.array(lang)), pa.array([_gram(c) for c in code.tolist()], pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for first, grams in _pieces(batch.column(0)):
                tags = batch.column(1).slice(first, len(grams.counts)).to_pylist()
                lang = np.array([numbers.setdefault(t, len(numbers)) for t in tags], dtype=np.int64)[grams.row]
                held.append(_summed(lang, grams.code, np.ones(len(grams.code), dtype=np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield sent()
        if held:
            yield sent()

    tagged = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(spelled(F.col(text_col)), F.col(lang_col).cast("string"))
    counted = tagged.mapInArrow(run, "lang string, gram string, n long")
    return cut(counted.groupBy("lang", "gram").agg(F.sum("n").alias("count")), "grams")


def fit_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP_GRAMS) -> DataFrame:
    """(lang, gram, count, weight): for each language the log share of each trigram that is among the ``top`` of some language."""
    counts = gram_counts(df, text_col, lang_col)
    # at most ``top`` rows per language, as are the languages of a table
    known = cut(ranking.first_per_group(counts, ["lang"], [F.col("count").desc(), F.col("gram").asc()], top).select("gram").distinct(), "known")
    kept = cut(counts.join(F.broadcast(known), "gram"), "kept")
    totals = kept.groupBy("lang").agg(F.sum("count").alias("_n"))
    # one entry per language
    languages = totals.agg(F.collect_list(F.struct("lang", "_n"))).scalar()
    every = known.select("gram", F.inline(languages)).join(kept, ["lang", "gram"], "left")
    size = known.agg(F.count(F.lit(1))).scalar()
    count = F.coalesce("count", F.lit(0).cast("long"))
    share = (count + SMOOTHING) / (F.col("_n") + SMOOTHING * size)
    return every.select("lang", "gram", count.alias("count"), F.round(F.log(share), 6).alias("weight"))


@dataclass(frozen=True)
class Profiles:
    """Log shares by trigram (ascending numbers) and language (in name order)."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray

    @classmethod
    def from_table(cls, table: DataFrame, limit: int = MAX_ROWS) -> "Profiles":
        """Read a frozen profile table; refuses one above its fixed size. A missing weight makes its trigram an error."""
        rows = table.select("lang", "gram", "weight").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"language profile table exceeds {limit} rows")
        languages = tuple(sorted({r.lang for r in rows}))
        codes = np.array(sorted({_code(r.gram) for r in rows}), dtype=np.int64)
        weights = np.full((len(codes), len(languages)), np.nan)
        place = {c: i for i, c in enumerate(codes.tolist())}
        for r in rows:
            if r.weight is not None:
                weights[place[_code(r.gram)], languages.index(r.lang)] = r.weight
        return cls(languages, codes, weights)

    def sums(self, grams: _Grams, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits and scores of each row over the trigrams that are ``taken``."""
        rows = len(grams.counts)
        row, code = grams.row[taken], grams.code[taken]
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        # equal trigrams of a row are added as one
        cell, n = np.unique(row[known] * max(len(self.codes), 1) + at[known], return_counts=True)
        row, at = np.divmod(cell, max(len(self.codes), 1))
        hits = np.bincount(row, n, minlength=rows).astype(np.int64)
        score = np.zeros((rows, max(len(self.languages), 1)))
        for k in range(len(self.languages)):
            score[:, k] = np.bincount(row, n * self.weights[at, k], minlength=rows)
        return hits, score

    def posteriors(self, texts: pa.Array, taken: Sequence[Callable[[int, _Grams], np.ndarray]]) -> list[pa.Array]:
        """Hits and posterior of each text over the trigrams that are ``taken`` by each of some choices."""
        hits = np.zeros((len(taken), len(texts)), dtype=np.int64)
        score = np.zeros((len(taken), len(texts), max(len(self.languages), 1)))
        for first, grams in _pieces(texts):
            rows = slice(first, first + len(grams.counts))
            for i, choice in enumerate(taken):
                met, told = self.sums(grams, choice(first, grams))
                hits[i, rows] += met
                score[i, rows] += told
        if len(texts):
            score = np.exp(score - score.max(axis=2, keepdims=True))
            score /= score.sum(axis=2, keepdims=True)
        return [_per_row(*found) for found in zip(hits, score)]


def _drawn(grams: _Grams, keys: np.ndarray, run: int) -> np.ndarray:
    """Which trigrams a run draws: some DRAWS of each text, by its key, the run and their place; the same in every task."""
    y = ((keys % PRIME)[grams.row] * 7919 + run * 104_729 + grams.place * 15_485_863) % PRIME
    return (y * y + 12_345 * y) % PRIME * grams.counts[grams.row] < DRAWS * PRIME


def _per_row(hits: np.ndarray, p: np.ndarray) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
    return pa.StructArray.from_arrays([pa.array(hits, pa.int64()), lists], ["hits", "p"])


def _ranked(profiles: Profiles, found: Column) -> Column:
    """The languages by falling posterior; equal ones in name order."""
    return F.sort_array(F.array(*[
        F.struct((-F.get(found["p"], F.lit(k))).alias("neg"), F.lit(name).alias("lang")) for k, name in enumerate(profiles.languages)]))


def detect(df: DataFrame, table: DataFrame, text_col: str = "text", supported: Sequence[str] = tuple(C.SUPPORTED_LANGUAGES)) -> DataFrame:
    """Append ``COLUMNS`` by a frozen profile table. Rows of any text stay, each with a state."""
    profiles = Profiles.from_table(table)

    @F.arrow_udf("struct<hits:long,p:array<double>>")
    def posterior(texts: pa.Array) -> pa.Array:
        return profiles.posteriors(texts, [lambda _, grams: np.ones(len(grams.row), dtype=bool)])[0]

    text = F.col(text_col)
    found = df.withColumn("_found", posterior(spelled(text)))
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    blank = F.coalesce(F.trim(text) == "", F.lit(True)) | text.rlike(r"^[\s\p{Z}]*$")
    status = (
        F.when(blank | (F.col("_found.hits") == 0), "unknown").when(best["neg"].isNull() | F.isnan(best["neg"]), "error")
        .when(best["lang"].isin(list(supported)), "detected").otherwise("unsupported")
    )
    error = F.when(blank, "empty_text").when(F.col("_found.hits") == 0, "undetectable_text").when(F.col("language_status") == "error", "detector_error")
    ranked = _ranked(profiles, F.col("_found")) if profiles.languages else F.lit(None).cast("array<struct<neg:double,lang:string>>")
    told = found.withColumn("_ranked", ranked).withColumn("language_status", status).withColumn("language_error", error)
    good = F.col("language_status").isin("detected", "unsupported")
    return told.select(
        *[F.col(f"`{c}`") for c in df.columns], F.when(good, best["lang"]).alias("detected_language"), F.when(good, -best["neg"]).alias("posterior"),
        F.when(good, -second["neg"]).alias("runner_up_posterior"), "language_status", "language_error")


def stability(df: DataFrame, table: DataFrame, key_col: str, text_col: str = "text", runs: int = 3) -> DataFrame:
    """Append ``stable`` (all runs name the same language, or none), ``top_posterior`` and ``least_gap`` (over the runs, of the best to the
    second) of detection by random draws. Draws are a function of key, run and place, so a repeated task draws the same."""
    profiles = Profiles.from_table(table)

    @F.arrow_udf("array<struct<hits:long,p:array<double>>>")
    def drawn(texts: pa.Array, keys: pa.Array) -> pa.Array:
        ids = keys.to_numpy(zero_copy_only=False)
        parts = profiles.posteriors(texts, [lambda first, grams, run=run: _drawn(grams, ids[first:], run) for run in range(1, runs + 1)])
        order = np.arange(runs * len(texts)).reshape(runs, -1).T.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * runs, pa.int32()), pa.concat_arrays(parts).take(pa.array(order)))

    found = df.withColumn("_runs", drawn(spelled(F.col(text_col)), F.col(key_col).cast("long")))
    def judged(x: Column) -> Column:
        ranked = _ranked(profiles, x)
        hit = x["hits"] > 0
        return F.struct(
            F.when(hit, F.get(ranked, F.lit(0))["lang"]).otherwise("").alias("lang"),
            F.when(hit, -F.get(ranked, F.lit(0))["neg"]).otherwise(0.0).alias("top"),
            F.when(hit, F.get(ranked, F.lit(1))["neg"] - F.get(ranked, F.lit(0))["neg"]).otherwise(0.0).alias("gap"))

    told = found.withColumn("_runs", F.transform("_runs", judged))
    return told.select(
        *[F.col(f"`{c}`") for c in df.columns], (F.size(F.array_distinct("_runs.lang")) == 1).alias("stable"),
        F.array_max("_runs.top").alias("top_posterior"), F.array_min("_runs.gap").alias("least_gap"))
