"""Periodic runs of words, found with difference-cover longest common extensions on a harmonic grid.

A run is a stretch of words with smallest period p and at least ``max(min_length, 2 p)`` words that no neighbour extends. It holds two
neighbouring points of the grid 0, p, 2p, ..., and from the first such pair it reaches back less than p words. So for each period
the pairs of grid points are asked how far the words after and before them agree; all periods together make n ln n pairs. Most pairs
differ in their own word or in one of the next few. Texts in which some pair agrees for longer get an index of extensions:

* positions whose remainder modulo v is in a difference cover are sampled; only their suffixes are sorted (v words first, then by
  doubling, where only ties go on);
* any two positions reach sampled ones after fewer than v equal steps, as each difference modulo v is one of two members of the cover;
* from there the answer is the minimum of neighbouring common prefixes between two ranks, from a sparse table.

The same index over the words in reverse answers how far they agree backwards. A run is found for multiples of its period too, with the
same ends; the smallest period stays. A task handles a megabyte of texts at once, a longer text by itself; nothing is shuffled.

Rows: a null or empty text has no words and no run; keys may repeat or be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vozlake.llm import textscan as ts

MIN_LENGTH = 12
# FIXED VALUES: difference covers, v and members; every difference modulo v is one of two members
COVERS = {
    21: (0, 1, 4, 14, 16),
    73: (1, 2, 4, 8, 16, 32, 37, 55, 64),
}
#: beyond so many words the wider cover samples fewer positions
WIDE_FROM = 1 << 20
#: words that a pair is followed before its text gets an index
GLANCE = 8
#: grid pairs handled at once
PAIRS = 1 << 20

#: from a key and a number of words to the order in which the words are taken (None: as they are)
Arrange = Callable[[object, int], np.ndarray | None]


def _follow(x: np.ndarray, i: np.ndarray, j: np.ndarray, reach) -> np.ndarray:
    """How many words agree from i and j on, ``reach`` at most."""
    out = np.zeros(len(i), dtype=np.int64)
    reach = np.broadcast_to(reach, len(i))
    at, done = np.flatnonzero(reach > 0), 0
    while len(at):
        at, done = at[x[i[at] + done] == x[j[at] + done]], done + 1
        out[at] = done
        at = at[reach[at] > done]
    return out


class Extensions:
    """How far the words from any two positions agree. ``x`` holds numbers from 0 on; each text ends in one that is nowhere else."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.v = v = 73 if len(x) > WIDE_FROM else 21
        members = np.array(COVERS[v])
        self.members = len(members)
        self.slot = np.full(v, -1)
        self.slot[members] = np.arange(self.members)
        # steps from two remainders to sampled positions of both
        steps = np.full((v, v), v)
        for d in range(v - 1, -1, -1):
            sampled = self.slot[(np.arange(v) + d) % v] >= 0
            steps[np.ix_(sampled, sampled)] = d
        self.steps = steps
        self.places = (np.arange(-(-len(x) // v))[:, None] * v + members).ravel()
        self.places = self.places[self.places < len(x)]
        levels = self._sort()
        self.rank = levels[-1]
        self.table = self._minima(self._neighbours(levels))

    def _sort(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first v, 2v, 4v, ... words, up to the first where all differ."""
        m, padded = len(self.places), np.concatenate([self.x, np.zeros(self.v, dtype=self.x.dtype)]).astype(np.int64)
        bits = max(1, int(self.x.max(initial=0)).bit_length())
        width, keys = max(1, 62 // bits), []
        for first in range(0, self.v, width):
            key = np.zeros(m, dtype=np.int64)
            for t in range(first, min(first + width, self.v)):
                key = (key << bits) | padded[self.places + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, dtype=bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        levels, ahead = [rank], self.members
        while True:
            tied = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
            if not len(tied):
                return levels
            then = np.where(tied + ahead < m, rank[np.minimum(tied + ahead, m - 1)] + 1, 0)
            order = np.lexsort((then, rank[tied]))
            group, then, place = rank[tied][order], then[order], np.arange(len(tied))
            fresh = np.concatenate([[True], group[1:] != group[:-1]])
            parted = fresh | np.concatenate([[True], then[1:] != then[:-1]])
            offset = np.maximum.accumulate(np.where(parted, place, 0)) - np.maximum.accumulate(np.where(fresh, place, 0))
            rank = rank.copy()
            rank[tied[order]] = group + offset
            levels.append(rank)
            ahead *= 2

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of suffixes that follow each other in rank."""
        m = len(self.places)
        order = np.empty(m, dtype=np.int64)
        order[self.rank] = np.arange(m)
        a, b, blocks = order[:-1], order[1:], np.zeros(max(m - 1, 0), dtype=np.int64)
        for t in range(len(levels) - 1, -1, -1):
            i, j = a + blocks * self.members, b + blocks * self.members
            inside = np.maximum(i, j) < m
            same = inside & (levels[t][np.minimum(i, m - 1)] == levels[t][np.minimum(j, m - 1)])
            blocks += same.astype(np.int64) << t
        words = blocks * self.v
        return words + _follow(self.x, self.places[a] + words, self.places[b] + words, self.v - 1)

    @staticmethod
    def _minima(values: np.ndarray) -> np.ndarray:
        """Row k has the minimum of 2**k values from each place on."""
        depth = max(1, len(values).bit_length())
        table = np.zeros((depth, len(values)), dtype=np.int32)
        table[:1] = values
        for k in range(1, depth):
            half = 1 << (k - 1)
            size = len(values) - 2 * half + 1
            table[k, :size] = np.minimum(table[k - 1, :size], table[k - 1, half:half + size])
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        steps = self.steps[i % self.v, j % self.v]
        out = _follow(self.x, i, j, steps)
        at = np.flatnonzero(out == steps)
        ranks = []
        for p in (i[at] + steps[at], j[at] + steps[at]):
            ranks.append(self.rank[(p // self.v) * self.members + self.slot[p % self.v]])
        low, high = np.minimum(*ranks), np.maximum(*ranks)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out[at] += np.minimum(self.table[k, low], self.table[k, high - (1 << k)])
        return out


def _framed(ids: np.ndarray, first: np.ndarray, texts: np.ndarray, unused: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts with a number of its own before and after each, and where each text begins there."""
    counts = np.diff(first)[texts]
    begin = np.cumsum(counts + 1) - counts
    x = np.empty(int((counts + 1).sum()) + 1, dtype=np.int64)
    x[0] = unused
    x[begin + counts] = unused + 1 + np.arange(len(texts))
    x[ts.slices(begin, counts)] = ids[ts.slices(first[texts], counts)]
    return x, begin


def _grid(begin: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, point, period) of all neighbouring grid points, in blocks."""
    periods = counts // 2
    text = np.repeat(np.arange(len(counts)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (counts[text] - 1) // period
    ends = np.cumsum(pairs)
    low = 0
    while low < len(text):
        done = int(ends[low - 1]) if low else 0
        high = max(int(np.searchsorted(ends, done + PAIRS, side="right")), low + 1)
        n = pairs[low:high]
        p = np.repeat(period[low:high], n)
        k = np.arange(len(p)) - np.repeat(ends[low:high] - n - done, n)
        t = np.repeat(text[low:high], n)
        yield t, begin[t] + k * p, p
        low = high


def _runs_of(t, i, p, after, before, begin, min_length: int) -> np.ndarray:
    """Rows (text, start, length, period) of the pairs that lie in a run and are its first."""
    good = (before < p) & (after + before >= np.maximum(p, min_length - p))
    t, i, p, after, before = (a[good] for a in (t, i, p, after, before))
    return np.stack([t, i - before - begin[t], p + after + before, p], axis=1)


def runs(ids: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period), by text, start and period. ``ids`` numbers equal words of all texts alike from 0 on."""
    unused = int(ids.max(initial=-1)) + 1
    texts = np.flatnonzero(np.diff(first) >= max(min_length, 2))
    found = [np.zeros((0, 4), dtype=np.int64)]
    if len(texts):
        x, begin = _framed(ids, first, texts, unused)
        y, deep = x[::-1].copy(), np.zeros(len(texts), dtype=bool)
        for t, i, p in _grid(begin, np.diff(first)[texts]):
            same = x[i] == x[i + p]
            t, i, p = t[same], i[same], p[same]
            after, before = _follow(x, i, i + p, GLANCE), _follow(y, len(x) - i - p, len(x) - i, GLANCE)
            deep[t[(after == GLANCE) | (before == GLANCE)]] = True
            rows = _runs_of(t, i, p, after, before, begin, min_length)
            rows = rows[~deep[rows[:, 0]]]
            found.append(np.column_stack([texts[rows[:, 0]], rows[:, 1:]]))
        # a text may have been seen to need an index after some of its rows were taken
        shallow = np.ones(len(first), dtype=bool)
        shallow[texts[deep]] = False
        found = [f[shallow[f[:, 0]]] for f in found]
        texts = texts[deep]
    if len(texts):
        x, begin = _framed(ids, first, texts, unused)
        forward, backward = Extensions(x), Extensions(x[::-1].copy())
        for t, i, p in _grid(begin, np.diff(first)[texts]):
            same = x[i] == x[i + p]
            t, i, p = t[same], i[same], p[same]
            rows = _runs_of(t, i, p, forward(i, i + p), backward(len(x) - i - p, len(x) - i), begin, min_length)
            found.append(np.column_stack([texts[rows[:, 0]], rows[:, 1:]]))
    rows = np.concatenate(found)
    # multiples of a period find the same stretch
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    least = np.ones(len(rows), dtype=bool)
    least[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[least]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def looped(key: object, n: int) -> np.ndarray | None:
    """For a tenth of the keys, by CRC-32: words from some place on repeat the stretch that begins there."""
    mark = zlib.crc32(str(key).encode()) if key is not None else 1
    if mark % 10 or not n:
        return None
    g = mark // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % period
    return order


def _chunk_rows(chunk: ts.Chunk, keys: list, arrange: Arrange | None, min_length: int) -> Iterator[tuple]:
    """Per text: its runs, its words kept, and all of both digested."""
    words = ts.words(chunk)
    first, orders = words.first, {}
    hashes = words.hashes
    if arrange is not None:
        for d, n in enumerate(words.counts.tolist()):
            order = arrange(keys[d], n)
            if order is not None:
                orders[d] = order
                hashes[first[d]:first[d + 1]] = hashes[first[d]:first[d + 1]][order]
    ids = np.unique(hashes, return_inverse=True)[1]
    found = runs(ids, first, min_length)
    edges = np.searchsorted(found[:, 0], np.arange(chunk.count + 1))
    for d in range(chunk.count):
        own = found[edges[d]:edges[d + 1], 1:]
        kept = chunk.text(d).split()
        n = len(kept)
        if d in orders:
            kept = [kept[i] for i in orders[d].tolist()]
        if len(own):
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, own[:, 0] + own[:, 2], 1)
            np.add.at(cover, own[:, 0] + own[:, 1], -1)
            kept = [w for w, c in zip(kept, np.cumsum(cover).tolist()) if not c]
        yield n, own, b" ".join(kept)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
         arrange: Arrange | None = None, with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """Per document: key, n_words, n_runs, the longest run (start, length, period, exponent_milli; ties: the smallest start, then period),
    runs_sha256 and collapsed_sha256. Asked for, also all runs, and the text in which each run is cut back to its first period."""
    ts.bounded_batches(docs.sparkSession)
    given = docs.select(F.col(ts.quoted(key)).alias("_id"), F.col(ts.quoted(text)).cast("string").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()
    numbers = ["n_words", "n_runs", "start", "length", "period", "exponent_milli"]
    schema = ", ".join([f"{ts.quoted(key)} {kind}", *(f"{n} long" for n in numbers), "runs_sha256 string", "collapsed_sha256 string"])
    schema += ", runs array<struct<start:long,length:long,period:long>>" * with_runs + ", collapsed string" * with_text
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(1)):
                ids = batch.column(0).slice(chunk.first, chunk.count)
                out = []
                for n, own, kept in _chunk_rows(chunk, ids.to_pylist() if arrange else [], arrange, min_length):
                    best = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist() if len(own) else None
                    listed = "".join(f"{s},{m},{p}\n" for s, m, p in own.tolist())
                    row = (n, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                           hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                    row += ([dict(zip(("start", "length", "period"), r)) for r in own.tolist()],) * with_runs
                    out.append(row + (kept.decode(),) * with_text)
                types = [pa.int64()] * 6 + [pa.string()] * 2 + [run_type] * with_runs + [pa.string()] * with_text
                names = [*numbers, "runs_sha256", "collapsed_sha256"] + ["runs"] * with_runs + ["collapsed"] * with_text
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([ids, *columns], [key, *names])

    return given.mapInArrow(rows, schema)
