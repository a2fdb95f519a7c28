"""Counts of words and adjacent pairs over many texts, summed in the task before anything is shuffled.

Tokens are found in the JVM. In the task words are numbers (of a bounded stretch of the texts), a pair is one number made of two,
and equal terms are summed by sorting; a stretch sends one row per term that it met.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: tokens whose terms a task holds at once; a text of more is alone
HELD = 1 << 18


def _stretches(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, low = np.cumsum(lengths), 0
    while low < len(lengths):
        before = int(ends[low - 1]) if low else 0
        high = max(int(np.searchsorted(ends, before + HELD, side="right")), low + 1)
        yield low, high
        low = high


def _numbered(columns: Sequence[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each row by its values (null is one), and a row of each group."""
    group = np.zeros(rows, dtype=np.int64)
    for column in columns:
        value = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        group = np.unique(group * (value.max(initial=0) + 1) + value, return_inverse=True)[1]
    return group, np.unique(group, return_index=True)[1]


def partial_counts(df: DataFrame, tokens: Column, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., feature, df, tf): texts that hold a word or adjacent pair, and its occurrences; several rows of a term are to be summed.

    The empty feature counts the texts that are not null. Tokens hold no blank.
    """
    k = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high in _stretches(lengths):
                part = batch.slice(low, high - low)
                of_row, example = _numbered([part.column(i) for i in range(k)], part.num_rows)
                row = np.repeat(np.arange(part.num_rows), lengths[low:high])
                coded = part.column(k).flatten().dictionary_encode()
                words, word = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
                size, n_groups = len(words) + 1, len(example)
                both = np.flatnonzero(row[1:] == row[:-1])
                # first word + 1, second word + 1 or 0
                term = np.concatenate([word * size, word[both] * size + word[both + 1]])
                row = np.concatenate([row, row[both]])
                # a batch's rows times the square of a stretch's words is below 2 ** 63
                span = size * size
                occurs = np.unique(of_row[row] * span + term, return_counts=True)
                found = np.sort(row * span + term)
                found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
                texts = np.unique(of_row[found // span] * span + found % span, return_counts=True)
                group, at = np.divmod(occurs[0], span)
                first, second = np.divmod(at, size)
                left = words.take(pa.array(first - 1))
                right = words.take(pa.array(second - 1, mask=second == 0))
                feature = pc.coalesce(pc.binary_join_element_wise(left, right, " "), left)
                given = np.bincount(of_row, pc.is_valid(part.column(k)).to_numpy(zero_copy_only=False), minlength=n_groups).astype(np.int64)
                every = pa.array(example[np.concatenate([group, np.arange(n_groups)])])
                yield pa.RecordBatch.from_arrays([
                    *[part.column(i).take(every) for i in range(k)], pa.concat_arrays([feature, pa.array([""] * n_groups, pa.string())]),
                    pa.array(np.concatenate([texts[1], given])), pa.array(np.concatenate([occurs[1], given]))], [*groups, "feature", "df", "tf"])

    given = df.select(*[F.col(f"`{g}`") for g in groups], tokens.alias("_tokens"))
    fields = [*given.schema.fields[:k], T.StructField("feature", T.StringType()), T.StructField("df", T.LongType()), T.StructField("tf", T.LongType())]
    return given.mapInArrow(run, T.StructType(fields))
