"""N-gram Jaccard join with grouped prefixes, for links and their components.

Two documents link when the Jaccard similarity of their shingle sets is at least ``percent`` in a hundred. Sets are of 64-bit shingle
hashes; documents with equal sets are one set with a count. Sets that can link at all are few, so the work narrows in steps:

1. Overlap of prefixes. In hash order, two sets that link share at least l of their first n - ceil(t n) + l shingles. A set of
   whose prefix fewer than l shingles are in any other prefix links with nothing.
2. Frequency order. For the sets left, shingles get a frequency class (rare first, then by hash). A set of which more than n - ceil(t n)
   shingles are its own alone links with nothing; c is the number of the others. The prefix of n - ceil(t n) + 1 shingles, less those
   of its own, is what it is found by.
3. Pivots. Per prefix shingle the set with most copies is the pivot; each set is verified against the pivot it meets most. That joins
   a group of near copies in a number of checks that is linear in the group.
4. Groups. Sets with identical prefixes, sizes and component so far collapse into one group. Pairs of groups that share a prefix shingle,
   are in different components and whose sizes allow the overlap (of at most the smaller c) are expanded, and all their members
   verified. Pairs inside one component need no check, as components are the result.

Hashes are dealt into buckets as in :mod:`vozlake.llm.dealing`; no step makes all pairs of a group, and nothing is cut short.

Rows: a document with fewer words than ``words`` has its whole sequence as one shingle; one without words (or with a null text) has none
and is a component by itself; keys may repeat, a null key counts as larger than all others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vozlake.durable import cut
from vozlake.llm import textscan as ts
from vozlake.llm.components import components
from vozlake.llm.dealing import attach, batch_of, by_bucket, pack_sorted, unpack_sorted, with_repeats

#: shingle hashes that meet in one bucket, which is one task
BUCKET_HASHES = 2_000_000


def missing(n, percent: int):
    """How many shingles of a set of n its partner may lack: n - ceil(n * percent / 100)."""
    return n * (100 - percent) // 100


def shingle_sets(chunk: ts.Chunk, k: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    words = ts.words(chunk, ts.NOT_SPACE, folded=True)
    grams = ts.grams(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            out.append(ts.mix(ts.grams(words.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _labelled(docs: DataFrame, k: int) -> DataFrame:
    """Stored stage: _id, n_shingles and _set (key of the set, null if empty) of each document."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(1)):
                sets = shingle_sets(chunk, k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.count), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())], ["_id", "n_shingles", "_set"])

    return cut(docs.select("_id", "_text").mapInArrow(run, f"_id {kind}, n_shingles long, _set binary"), "shingled")


#: what a task sends to a bucket: hashes that count, hashes that ask (with each one's number in its chunk), and once a chunk its names
_ROWS = "bucket int, kind int, chunk long, hashes binary, counts binary, at binary"
_NAMES = ["bucket", "kind", "chunk", "hashes", "counts", "at"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_COUNT, _ASK, _NAME = 0, 1, 2


def _prefix_rows(chunk: int, sets: list[np.ndarray], keys: list[bytes], percent: int, buckets: int) -> list[tuple]:
    """Prefixes that others may count on, and those whose shared shingles this set counts."""
    shown, counted, at = [], [], []
    for i, s in enumerate(sets):
        n = len(s)
        if n:
            largest = n * 100 // percent
            # the smallest hashes, so they are mixed anew before their value deals them out
            shown.append(ts.mix(s[:missing(n, percent) + missing(largest, percent) + 1]))
            counted.append(ts.mix(s[:2 * missing(n, percent) + 1]))
            at.append(np.full(len(counted[-1]), i, dtype=np.uint32))
    if not shown:
        return []
    rows = [(chunk % buckets, _NAME, chunk, b"".join(keys), np.array([len(s) for s in sets], dtype="<u4").tobytes(), None)]
    distinct, again = with_repeats(np.sort(np.concatenate(shown)))
    for values in (distinct, again):
        rows += [(b, _COUNT, chunk, pack_sorted(values[own]), None, None) for b, own in by_bucket(values, 64, buckets)]
    values, of = np.concatenate(counted), np.concatenate(at)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    rows += [(b, _ASK, chunk, pack_sorted(values[own]), None, of[own].astype("<u4").tobytes()) for b, own in by_bucket(values, 64, buckets)]
    return rows


def _summed(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, n = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(n, first) if len(first) else n


class _Counter:
    """Counts of the hashes of one bucket, folded together now and then."""

    def __init__(self) -> None:
        self.parts, self.counts, self.size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append(values)
        self.counts.append(counts)
        self.size += len(values)
        if self.size > 1 << 22:
            self._fold()

    def _fold(self) -> None:
        values, counts = _summed(self.parts, self.counts)
        self.parts, self.counts, self.size = [values], [counts], 0

    def look_up(self, values: np.ndarray) -> np.ndarray:
        if len(self.parts) > 1:
            self._fold()
        known, counts = self.parts[0], self.counts[0]
        if not len(known):
            return np.zeros(len(values), np.int64)
        place = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[place] == values, counts[place], 0)


def candidates(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """(_key) of the texts of which more prefix shingles are in other prefixes too than a partner may lack (step 1).

    A bucket answers each chunk in one row by numbers within the chunk; a chunk's answers are added up before texts get rows
    of their own. Texts with copies always pass."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for chunk in ts.chunks(batch.column(1)):
                yield batch_of(_prefix_rows(chunk_id, shingle_sets(chunk, k), keys[chunk.first:chunk.first + chunk.count], percent, buckets), _NAMES, _TYPES)
                chunk_id += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, met = None, None
        for batch in batches:
            out = []
            for b, kind, chunk, hashes, counts, at in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    bucket, met = b, _Counter()
                if kind == _NAME:
                    out.append((chunk, hashes, counts, None, None))
                    continue
                values = unpack_sorted(hashes)
                if kind == _COUNT:
                    met.add(values, np.ones(len(values), np.int64))
                    continue
                shared = np.bincount(np.frombuffer(at, dtype="<u4"), met.look_up(values) > 1)
                some = np.flatnonzero(shared)
                if len(some):
                    out.append((chunk, None, None, some.astype("<u4").tobytes(), shared[some].astype("<u4").tobytes()))
            yield batch_of(out, ["chunk", "names", "sizes", "at", "shared"], [pa.int64()] + [pa.binary()] * 4)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk, names first."""
        now, names, sizes, sums = None, b"", None, None

        def passing() -> pa.RecordBatch:
            some = np.flatnonzero(sums > missing(sizes, percent)).tolist() if now is not None else []
            return pa.RecordBatch.from_arrays([pa.array([names[16 * i:16 * i + 16] for i in some], pa.binary())], ["_key"])

        for batch in batches:
            for chunk, named, counts, at, shared in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    yield passing()
                    now, names, sizes = chunk, named, np.frombuffer(counts, dtype="<u4").astype(np.int64)
                    sums = np.zeros(len(sizes), dtype=np.int64)
                else:
                    sums[np.frombuffer(at, dtype="<u4")] += np.frombuffer(shared, dtype="<u4")
        yield passing()

    dealt = docs.select("_key", "_text").mapInArrow(emit, _ROWS).repartitionById(buckets, F.col("bucket"))
    answers = dealt.sortWithinPartitions("bucket", "kind").mapInArrow(
        count, "chunk long, names binary, sizes binary, at binary, shared binary")
    by_chunk = answers.repartition("chunk").sortWithinPartitions(F.col("chunk"), F.col("names").isNull())
    return by_chunk.mapInArrow(add, "_key binary").distinct()


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """Stored stage: distinct sets (_set, _n, _hashes) of the candidate texts (_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(0)):
                rows = [(set_key(s), len(s), s.astype("<u8").tobytes()) for s in shingle_sets(chunk, k) if len(s)]
                yield batch_of(rows, ["_set", "_n", "_hashes"], [pa.binary(), pa.int64(), pa.binary()])

    found = texts.select("_text").mapInArrow(run, "_set binary, _n long, _hashes binary")
    return cut(found.groupBy("_set", "_n").agg(F.any_value("_hashes").alias("_hashes")), "sets")


def _classes(sets: DataFrame, buckets: int) -> DataFrame:
    """(_set, _classes): for each hash of a set in order, the number of bits of its frequency less one (0: its own alone)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            low = 0
            while low < len(keys):
                high, size = low, 0
                while high < len(keys) and (high == low or size < ts.CHUNK_BYTES):
                    size += len(raw[high])
                    high += 1
                values = np.frombuffer(b"".join(raw[low:high]), dtype="<u8")
                of = np.repeat(np.arange(high - low, dtype=np.uint32), [len(r) // 8 for r in raw[low:high]])
                order = np.lexsort((of, values))
                values, of = values[order], of[order]
                rows = [(chunk % buckets, _NAME, chunk, b"".join(keys[low:high]), None, None)]
                for b, own in by_bucket(values, 64, buckets):
                    distinct, n = np.unique(values[own], return_counts=True)
                    rows.append((b, _COUNT, chunk, pack_sorted(distinct), n.astype("<u4").tobytes(), None))
                    rows.append((b, _ASK, chunk, pack_sorted(values[own]), None, of[own].astype("<u4").tobytes()))
                yield batch_of(rows, _NAMES, _TYPES)
                low, chunk = high, chunk + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, met = None, None
        for batch in batches:
            out = []
            for b, kind, chunk, hashes, counts, at in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    bucket, met = b, _Counter()
                if kind == _NAME:
                    out.append((chunk, -1, hashes, None))
                    continue
                values = unpack_sorted(hashes)
                if kind == _COUNT:
                    met.add(values, np.frombuffer(counts, dtype="<u4").astype(np.int64))
                    continue
                often = np.ceil(np.log2(np.maximum(met.look_up(values), 1))).astype(np.uint8)
                out.append((chunk, b, at, often.tobytes()))
            yield batch_of(out, ["chunk", "bucket", "at", "classes"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    def line_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk, names first, then by bucket; a bucket is a range of hashes, so each set's hashes are ascending."""
        now, names, at, often = None, b"", [], []

        def sets_of() -> pa.RecordBatch:
            of = np.frombuffer(b"".join(at), dtype="<u4")
            order = np.argsort(of, kind="stable")
            flat = np.frombuffer(b"".join(often), dtype=np.uint8)[order].tobytes()
            edges = np.searchsorted(of[order], np.arange(len(names) // 16 + 1))
            rows = [(names[16 * i:16 * i + 16], flat[edges[i]:edges[i + 1]]) for i in range(len(names) // 16)]
            return batch_of(rows, ["_set", "_classes"], [pa.binary(), pa.binary()])

        for batch in batches:
            for chunk, bucket, where, classes in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    yield sets_of()
                    now, names, at, often = chunk, where, [], []
                else:
                    at.append(where)
                    often.append(classes)
        yield sets_of()

    dealt = sets.select("_set", "_hashes").mapInArrow(emit, _ROWS).repartitionById(buckets, F.col("bucket"))
    met = dealt.sortWithinPartitions("bucket", "kind").mapInArrow(count, "chunk long, bucket int, at binary, classes binary")
    return met.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(line_up, "_set binary, _classes binary")


def _prefixes(sets: DataFrame, classes: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """Stored stage: _set, _n, _c, _copies, _cells (prefix shingles shared with others, in frequency order), _hashes of each
    set that may still link (step 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw, cls, many in zip(*(c.to_pylist() for c in batch.columns)):
                values, often = np.frombuffer(raw, dtype="<u8"), np.frombuffer(cls, dtype=np.uint8)
                n = len(values)
                spare = missing(n, percent)
                c = int((often > 0).sum())
                if n - c > spare:
                    continue
                cells = values[np.lexsort((values, often))][n - c:spare + 1]
                rows.append((name, n, c, many, cells.view(np.int64).tolist(), raw))
            yield batch_of(rows, ["_set", "_n", "_c", "_copies", "_cells", "_hashes"], [
                pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()])

    joined = sets.join(classes, "_set").join(copies, "_set").select("_set", "_hashes", "_classes", "_copies")
    return cut(joined.mapInArrow(run, "_set binary, _n long, _c long, _copies long, _cells array<long>, _hashes binary"), "prefixes")


def _may_link(percent: int, left: str, right: str) -> Column:
    """Sizes allow it: an overlap of at most the smaller c reaches percent of the union."""
    n = F.col(f"{left}_n") + F.col(f"{right}_n")
    overlap = F.least(f"{left}_c", f"{right}_c", f"{left}_n", f"{right}_n")
    return (100 + percent) * overlap >= percent * n


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs of sets (a, b), those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left = sets.select(F.col("_set").alias("a"), F.col("_hashes").alias("_x"))
    right = sets.select(F.col("_set").alias("b"), F.col("_hashes").alias("_y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y")
    return both.mapInArrow(run, "a binary, b binary")


def _pivot_pairs(found: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the pivot that it meets most (step 3)."""
    cells = found.select("_set", "_n", "_c", "_copies", F.explode("_cells").alias("_cell"))
    best = F.max(F.struct("_copies", "_c", "_set", "_n")).alias("_p")
    pivots = cells.groupBy("_cell").agg(best).select(
        "_cell", F.col("_p._set").alias("b"), F.col("_p._n").alias("b_n"), F.col("_p._c").alias("b_c"))
    met = cells.select(F.col("_set").alias("a"), F.col("_n").alias("a_n"), F.col("_c").alias("a_c"), "_cell").join(pivots, "_cell")
    met = met.filter((F.col("a") != F.col("b")) & _may_link(percent, "a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_votes"))
    return met.groupBy("a").agg(F.max(F.struct("_votes", "b")).alias("_top")).select("a", F.col("_top.b").alias("b"))


def _group_pairs(found: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of pairs of groups that may link across components (step 4)."""
    named = found.join(labels, found["_set"] == labels["node"], "left").select(
        "_set", "_n", "_c", "_cells", F.coalesce("component", "_set").alias("_label"))
    group = F.unhex(F.md5(F.concat_ws("|", F.hex("_label"), "_n", "_c", F.array_join("_cells", ","))))
    members = cut(named.withColumn("_group", group), "members")
    groups = members.groupBy("_group", "_label", "_n", "_c").agg(F.any_value("_cells").alias("_cells"))
    # what a prefix shingle at this place leaves for an overlap, if it is the first that both have
    shown = cut(groups.select("_group", "_label", "_n", "_c", F.posexplode("_cells").alias("_pos", "_cell")).select(
        "_group", "_label", "_n", (F.col("_c") - F.col("_pos")).alias("_c"), "_cell"), "shown")
    # most shingles are in one component only
    across = shown.groupBy("_cell").agg(F.min("_label").alias("_x"), F.max("_label").alias("_y")).filter(F.col("_x") != F.col("_y"))
    shown = cut(shown.join(across.select("_cell"), "_cell", "left_semi"), "shown")
    side = lambda p: shown.select("_cell", *[F.col(f"_{c}").alias(f"{p}_{c}") for c in ("group", "label", "n", "c")])
    both = (F.col("l_group") < F.col("r_group")) & (F.col("l_label") != F.col("r_label")) & _may_link(percent, "l", "r")
    # a pair may come from each shingle that both have
    pairs = side("l").join(side("r"), "_cell").filter(both).select("l_group", "r_group").distinct()
    of = lambda p, name: members.select(F.col("_group").alias(f"{p}_group"), F.col("_set").alias(name))
    return pairs.join(of("l", "a"), "l_group").join(of("r", "b"), "r_group").select("a", "b")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles and component_id, the smallest key that links reach."""
    ts.bounded_batches(docs.sparkSession)
    given = docs.select(F.col(ts.quoted(key)).alias("_id"), F.coalesce(F.col(ts.quoted(text)).cast("string"), F.lit("")).alias("_text"))
    keyed = given.withColumn("_key", F.unhex(F.md5("_text")))
    rows = _labelled(given, words)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    hashes = max(1, total * 2 * (100 - percent) // 100)
    shared = candidates(keyed, words, percent, max(1, -(-hashes // BUCKET_HASHES)))
    # copies meet here once per map task
    texts = keyed.groupBy("_key").agg(F.any_value("_text").alias("_text"))
    sets = _sets(texts.join(shared, "_key"), words)
    size = sets.agg(F.sum("_n")).first()[0] or 0
    copies = rows.filter(F.col("_set").isNotNull()).groupBy("_set").agg(F.count(F.lit(1)).alias("_copies"))
    found = _prefixes(sets, _classes(sets, max(1, -(-size // BUCKET_HASHES))), copies, percent)
    near = cut(verified(_pivot_pairs(found, percent), found, percent), "links")
    first = components(near, "a", "b")
    links = cut(near.unionByName(verified(_group_pairs(found, first, percent), found, percent)), "links")
    named = components(links, "a", "b")
    own = rows.join(named, rows["_set"] == named["node"], "left").select(
        "_id", "n_shingles", F.coalesce("component", "_set").alias("_component"))
    own = cut(own, "named")
    some = own.filter(F.col("_component").isNotNull())
    least = some.groupBy("_component").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    out = attach(some, least, "_component").select("_id", "n_shingles", "_least").unionByName(
        own.filter(F.col("_component").isNull()).select("_id", "n_shingles", F.col("_id").alias("_least")))
    return out.select(F.col("_id").alias(key), "n_shingles", F.col("_least").alias("component_id"))
