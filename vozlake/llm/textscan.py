"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Separators are ASCII in every contract here, so a word is a run of bytes of one
class and nothing needs decoding. A word gets a 64-bit hash of its bytes: its length
and then eight bytes at a time go through a mixing function, and spans above 256 bytes
go through BLAKE2. Equal words have equal hashes in every task; different words
collide with a chance near 2**-64, whatever the pattern of their bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: bytes of text handled at once; a longer text is handled alone
CHUNK_BYTES = 1 << 20
#: a longer span is hashed by itself
LONG_SPAN = 256

#: bytes of rows handed to Python at once
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


_UNITS = {"": 1, "b": 1, **{u + b: 1 << (10 * i) for i, u in enumerate("kmgtp", 1) for b in ("", "b")}}


def size_of(setting: str) -> int:
    """Bytes of a size as settings have it, such as ``64m``, ``64MB`` or ``67108864``; negative for no bound."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(number) * _UNITS[unit]


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch: ten thousand rows of long texts fill Spark's own bound, and a task
    holds a batch several times. The plans run later than this call, so the setting stays as it is then."""
    now = size_of(spark.conf.get(_BATCH_SETTING))
    if now > BATCH_BYTES or now <= 0:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def quoted(name: str) -> str:
    """A column's name as expressions and schema strings take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over 64 bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0xA0761D6478BD642F
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: the lowest bytes of a lane of eight
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

#: bytes of words separated by white space: all but 0x09-0x0D and 0x20
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[*range(9, 14), 32]] = False
#: bytes of alphanumeric words: digits, ASCII letters and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

@dataclass
class Chunk:
    """Some texts: their bytes end to end and where each begins (one more offset than texts)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``limit`` bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column), pa.string())
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0:
        return
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield Chunk(low, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


@dataclass
class Words:
    """Words in order: byte positions, the text each belongs to, and per text where its words begin."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # one more entry than texts
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def spans(chunk: Chunk, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes of ``kind``, broken where a text ends."""
    data = chunk.data
    if data.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = chunk.offsets[1:-1]
    before[cuts[cuts < data.size]] = False
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False, seed: int = 0) -> np.ndarray:
    """Hash of the bytes of each span; ``folded`` takes A-Z as a-z."""
    if folded:
        data = _FOLDED[data]
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place on
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64)))
    out = mix(out ^ (lanes[starts] & _LOWEST[np.minimum(lengths, 8)]))
    at, done = np.flatnonzero((lengths > 8) & (lengths <= LONG_SPAN)), 8
    while len(at):
        left = lengths[at] - done
        out[at] = mix(out[at] ^ (lanes[starts[at] + done] & _LOWEST[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8, key=seed.to_bytes(8, "little"))
        out[i] = np.frombuffer(digest.digest(), dtype="<u8")[0]
    return out


def words(chunk: Chunk, kind: np.ndarray = NOT_SPACE, folded: bool = False) -> Words:
    starts, ends = spans(chunk, kind)
    first = np.searchsorted(starts, chunk.offsets)
    doc = np.repeat(np.arange(chunk.count), np.diff(first))
    return Words(starts, ends, doc, first, span_hashes(chunk.data, starts, ends, folded))


def grams(hashes: np.ndarray, n: int, step: int = _STEP) -> np.ndarray:
    """Hash of every run of ``n`` hashes (by doubling, so a run of 35 takes seven passes).

    Runs above 64 are mixed at each doubling, as plain powers have patterns of that length with equal sums."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, taken, run, length = None, 0, hashes, 1
    with np.errstate(over="ignore"):
        while True:
            if n & length:
                if total is None:
                    total = run
                else:
                    keep = len(hashes) - (taken + length) + 1
                    total = total[:keep] * np.uint64(pow(step, length, 1 << 64)) + run[taken:taken + keep]
                taken += length
            if taken == n:
                break
            keep = len(run) - length
            run = run[:keep] * np.uint64(pow(step, length, 1 << 64)) + run[length:length + keep]
            if n > 64:
                run = mix(run)
            length *= 2
    return mix(total[:size])


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` words lie in one text."""
    return doc[:len(doc) - n + 1] == doc[n - 1:] if len(doc) >= n else np.zeros(0, dtype=bool)


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many stretches, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
