"""Quality rules: base counts, then divergence of a text's histograms from language references.

Two histograms describe a text: classes of its characters, and its common words (the function words of four
languages, and all others as one bin). The reference of a language is the sum over all documents tagged with it that
pass the base rule. A text is compared with each reference by Jensen-Shannon distance; it is kept if one reference is
near in both histograms. A short histogram strays from its own source by chance, so each limit grows by the expected
stray, and a histogram of fewer than ``MIN_COUNT`` counts is not judged. That is (bins - 1) / (8 n ln 2) of divergence for n
counts of characters. Most common words are of other languages, so theirs is the stray of the reference's own shares
(:func:`word_stray`); text without a common word then fails from ``MIN_COUNT`` words on.

Rows: a null text has no words and fails the base rule; keys may repeat or be null; a null or unknown language tag adds to no
reference but the text is judged like any other; with no reference at all (no tagged text passes) the base rule decides;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vozlake.durable import cut
from vozlake.llm import textscan as ts

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: a histogram with fewer counts is not judged
MIN_COUNT = 50
#: largest Jensen-Shannon distances (square roots of divergence in bits) of a kept text
MAX_CHARACTER_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.12
#: standard deviations above the mean stray of a language's own words that are allowed (the mean alone fails a quarter of clean short texts)
WORD_SPREADS = 2.0

# Frequent function words of the languages judged.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on are with as by be this from at or an have not",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
}
LANGUAGES = tuple(sorted(COMMON_WORDS))
_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})

#: class of each byte that begins a character; bytes within one have none
CLASSES = ("vowel", "lower", "upper", "digit", "space", "stop", "mark", "latin", "two", "three", "four")


def _byte_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("mark"), dtype=np.int64)
    for name, members in {
        "lower": range(97, 123), "vowel": b"aeiou", "upper": range(65, 91), "digit": range(48, 58),
        "space": [*range(9, 14), 32], "stop": b".,;:'\"?-", "latin": [0xC3], "two": [0xC2, *range(0xC4, 0xE0)],
        "three": range(0xE0, 0xF0), "four": range(0xF0, 0x100),
    }.items():
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = -1
    return table


_CLASS_OF = _byte_classes()
_STARTS = _CLASS_OF >= 0
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(sums[offsets])


def repeated_windows(words: ts.Words, n: int) -> np.ndarray:
    """Marks words inside runs of ``n`` words found twice or more in their text."""
    cover = np.zeros(len(words.doc) + 1, dtype=np.int64)
    at = np.flatnonzero(ts.within(words.doc, n))
    if len(at):
        key = ts.mix(ts.grams(words.hashes, n)[at] ^ ts.mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + n, -1)
    return np.cumsum(cover)[:-1] > 0


def duplicate_lines(chunk: ts.Chunk) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line."""
    starts, ends = ts.spans(chunk, _NOT_NEWLINE)
    solid = np.concatenate([[0], np.cumsum(ts.NOT_SPACE[chunk.data], dtype=np.int64)])
    has_word = solid[ends] > solid[starts]
    starts, ends = starts[has_word], ends[has_word]
    doc = np.searchsorted(chunk.offsets, starts, side="right") - 1
    key = ts.mix(ts.span_hashes(chunk.data, starts, ends) ^ ts.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    return np.bincount(doc[again], minlength=chunk.count)


def _common_index() -> tuple[np.ndarray, np.ndarray]:
    column = pa.array([" ".join(_WORDS)])
    chunk = next(ts.chunks(column))
    hashes = ts.words(chunk, ts.NOT_SPACE, folded=True).hashes
    order = np.argsort(hashes)
    return hashes[order], order


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Stored stage: base counts, language tag and both histograms of each document."""
    ts.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bins = _common_index()
        width = len(CLASSES)
        for batch in batches:
            for chunk in ts.chunks(batch.column(1)):
                words = ts.words(chunk)
                starts = _STARTS[chunk.data]
                solid = ts.NOT_SPACE[chunk.data]
                of_byte = np.repeat(np.arange(chunk.count), np.diff(chunk.offsets))
                classes = np.bincount((of_byte * width + _CLASS_OF[chunk.data])[starts], minlength=chunk.count * width)
                plain = ts.words(chunk, ts.ALNUM, folded=True)
                at = np.minimum(np.searchsorted(known, plain.hashes), len(known) - 1)
                bin_of = np.where(known[at] == plain.hashes, bins[at], len(known))
                common = np.bincount(plain.doc * (len(known) + 1) + bin_of, minlength=chunk.count * (len(known) + 1))
                repeated = np.bincount(words.doc[repeated_windows(words, 3)], minlength=chunk.count)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.count), batch.column(2).slice(chunk.first, chunk.count),
                    pa.array(words.counts), pa.array(_per_text(starts & solid, chunk.offsets)),
                    pa.array(_per_text(_SYMBOL[chunk.data], chunk.offsets)), pa.array(duplicate_lines(chunk)),
                    pa.array(repeated), _lists(classes, width), _lists(common, len(known) + 1),
                ], [key, "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_classes", "_common"])

    measured = docs.select(F.col(key), F.col(text).cast("string"), F.col(lang).cast("string").alias("_lang")).mapInArrow(
        run, f"{ts.quoted(key)} {kind}, _lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, _classes array<int>, _common array<int>")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return cut(measured.withColumn("base_failed", failed), "quality")


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def references(measured: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Shares of classes and of common words by language, over all its documents that pass the base rule.

    Each task sends at most one row per language of the fixed list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: [0, 0] for name in LANGUAGES}
        for batch in batches:
            for name in LANGUAGES:
                own = batch.filter(pc.fill_null(pc.equal(batch.column(0), name), False))
                for i, width in enumerate((len(CLASSES), len(_WORDS) + 1)):
                    sums[name][i] = sums[name][i] + _matrix(own.column(i + 1), width).sum(axis=0, dtype=np.int64)
        for name, (classes, common) in sums.items():
            if np.any(classes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([classes.tolist()]), pa.array([common.tolist()])], ["lang", "classes", "common"])

    sent = measured.filter(~F.col("base_failed")).select("_lang", "_classes", "_common").mapInArrow(
        run, "lang string, classes array<long>, common array<long>")
    total = lambda name, width: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(width)]).alias(name)
    rows = sent.groupBy("lang").agg(total("classes", len(CLASSES)), total("common", len(_WORDS) + 1)).collect()
    share = lambda v: np.array(v, dtype=float) / max(sum(v), 1)
    return {r.lang: (share(r.classes), share(r.common)) for r in sorted(rows)}


def word_stray(n: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Divergence by which n counts drawn from ``reference`` stray from it: the mean and ``WORD_SPREADS`` deviations.

    A bin of share r strays by (1 - r) / (8 n ln 2), a rare one by no more than r."""
    unit = 1 / (8 * np.log(2) * np.maximum(n, 1))
    mean = np.minimum((1 - reference) * unit[:, None], reference).sum(axis=1)
    return mean + WORD_SPREADS * np.sqrt(2 * mean * unit)


def distance(counts: np.ndarray, reference: np.ndarray, stray: np.ndarray | None = None) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of each row of counts from one distribution, less the expected stray (by default that of
    a reference with mass in every bin)."""
    n = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(n, 1)
    middle = (p + reference) / 2

    def part(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / middle), 0.0).sum(axis=1)

    divergence = (part(p) + part(np.broadcast_to(reference, p.shape))) / 2
    if stray is None:
        stray = (counts.shape[1] - 1) / (8 * np.log(2) * np.maximum(n[:, 0], 1))
    return np.sqrt(np.maximum(divergence - stray, 0.0))


def judge(measured: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds kept, the nearest language and its two distances (null where the histogram is too short or none is known)."""
    out = [c for c in measured.columns if not c.startswith("_")]
    schema = ", ".join(f"`{c}` {t}" for c, t in measured.dtypes if c in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = _matrix(batch.column("_classes"), len(CLASSES))
            common = _matrix(batch.column("_common"), len(_WORDS) + 1)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            size = batch.num_rows
            nearest = np.full(size, -1)
            best = np.full((2, size), np.inf)
            for i, (char_reference, word_reference) in enumerate(known.values()):
                stray = word_stray(common.sum(axis=1), word_reference)
                found = np.stack([distance(classes, char_reference), distance(common, word_reference, stray)])
                found[0, classes.sum(axis=1) < MIN_COUNT] = 0.0
                found[1, common.sum(axis=1) < MIN_COUNT] = 0.0
                excess = (found / np.array([[MAX_CHARACTER_DISTANCE], [MAX_WORD_DISTANCE]])).max(axis=0)
                held = (best / np.array([[MAX_CHARACTER_DISTANCE], [MAX_WORD_DISTANCE]])).max(axis=0)
                better = excess < held
                nearest[better] = i
                best[:, better] = found[:, better]
            near = (best[0] <= MAX_CHARACTER_DISTANCE) & (best[1] <= MAX_WORD_DISTANCE) | (nearest < 0)
            names = np.array([*known, None], dtype=object)
            none = nearest < 0
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in out), pa.array(~failed & near), pa.array(names[nearest], pa.string()),
                pa.array(np.where(none, 0.0, best[0]), mask=none), pa.array(np.where(none, 0.0, best[1]), mask=none),
            ], [*out, "kept", "nearest_lang", "character_distance", "word_distance"])

    return measured.mapInArrow(
        run, schema + ", kept boolean, nearest_lang string, character_distance double, word_distance double")


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    measured = measure(docs, key, text, lang)
    return judge(measured, references(measured))
