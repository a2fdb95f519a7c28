"""Substring deduplication with fixed-block anchors.

A window of ``window`` words that starts anywhere else too is removed. Every window holds a whole block of its text's grid of
non-overlapping blocks of (window + 1) // 2 words. So:

1. The blocks are indexed by hash, and every rolling window of a block's length, of every text, probes that index. A block that
   two places have is an anchor. Hashes are dealt into buckets by value; a chunk of texts sends each bucket one sorted,
   delta-coded list of distinct hashes, so a passage that every text has costs one entry per chunk.
2. Anchors are extended: only windows around an anchor block are candidates. Their 96-bit hashes are dealt out the same way, and those
   found twice or more are repeated. Neighbouring repeated windows join to maximal exact repeats, whose words go.

If two windows are equal, each one's own grid block is met by the other's rolling window, so both are candidates: no repeat is lost, and
shorter block hashes only add candidates. No pair of texts is ever made. Texts that are equal as a whole are handled as one text
with a count.

Rows: a null text has no words; keys may repeat or be null, equal rows are separate documents; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vozlake.durable import cut
from vozlake.llm import textscan as ts
from vozlake.llm.dealing import EDGE_BITS, batch_of, by_bucket, pack_sorted, unpack_sorted, with_repeats

WINDOW = 35
#: text whose hashes meet in one bucket, which is one task
BUCKET_BYTES = 16 << 20
_SPREAD = 16


_BLOCK_ROWS = ("bucket int, kind int, hashes binary, texts binary, at binary, ordinals binary")
_BLOCK_NAMES = ["bucket", "kind", "hashes", "texts", "at", "ordinals"]
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_INDEX, _PROBE, _OWNER = 0, 1, 2


def _block_rows(chunk: ts.Chunk, keys: list[bytes], window: int, block: int, bits: int, buckets: int) -> list[tuple]:
    words = ts.words(chunk)
    long_enough = words.counts >= window
    if not long_enough.any():
        return []
    at = np.flatnonzero(ts.within(words.doc, block) & long_enough[words.doc[:max(len(words.doc) - block + 1, 0)]])
    hashes = ts.grams(words.hashes, block)[at] >> np.uint64(64 - bits)
    probes, again = with_repeats(np.sort(hashes))
    place = at - words.first[words.doc[at]]
    on_grid = place % block == 0
    order = np.argsort(hashes[on_grid], kind="stable")
    owned, texts, ordinals = hashes[on_grid][order], words.doc[at][on_grid][order], (place[on_grid] // block)[order]
    index = with_repeats(owned)[0]
    rows = []
    for values, kind in ((index, _INDEX), (probes, _PROBE), (again, _PROBE)):
        rows += [(b, kind, pack_sorted(values[own]), None, None, None) for b, own in by_bucket(values, bits, buckets)]
    for b, own in by_bucket(owned, bits, buckets):
        named, where = np.unique(texts[own], return_inverse=True)
        rows.append((b, _OWNER, pack_sorted(owned[own]), b"".join(keys[i] for i in named.tolist()),
                     where.astype("<u4").tobytes(), ordinals[own].astype("<u4").tobytes()))
    return rows


def anchors(docs: DataFrame, window: int, bits: int, buckets: int) -> DataFrame:
    """(_key, _blocks): texts with the numbers of their blocks that two places have. ``docs`` has _key and _text."""
    block = (window + 1) // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for chunk in ts.chunks(batch.column(1)):
                rows = _block_rows(chunk, keys[chunk.first:chunk.first + chunk.count], window, block, bits, buckets)
                yield batch_of(rows, _BLOCK_NAMES, _BLOCK_TYPES)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket: its index, then what probes it, then the owners of its blocks."""
        bucket, index, met, parts = None, None, None, []
        for batch in batches:
            for b, kind, hashes, texts, at, ordinals in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    bucket, index, parts = b, None, []
                values = unpack_sorted(hashes)
                if kind == _INDEX:
                    parts.append(values)
                    if len(parts) > 256:
                        parts = [np.unique(np.concatenate(parts))]
                    continue
                if index is None:
                    index = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                    met, parts = np.zeros(len(index) + 1, dtype=np.uint8), []
                place = np.minimum(np.searchsorted(index, values), max(len(index) - 1, 0))
                found = index[place] == values if len(index) else np.zeros(len(values), bool)
                if kind == _PROBE:
                    place = place[found]
                    met[place] = np.minimum(met[place] + 1, 2)
                    continue
                twice = np.flatnonzero(found & (met[place] > 1))
                where = np.frombuffer(at, dtype="<u4")[twice]
                number = np.frombuffer(ordinals, dtype="<u4")[twice]
                yield batch_of([(texts[16 * i:16 * i + 16], n) for i, n in zip(where.tolist(), number.tolist())],
                               ["_key", "block"], [pa.binary(), pa.int32()])

    dealt = docs.select("_key", "_text").mapInArrow(emit, _BLOCK_ROWS).repartitionById(buckets, F.col("bucket"))
    met = dealt.sortWithinPartitions("bucket", "kind").mapInArrow(probe, "_key binary, block int")
    return met.groupBy("_key").agg(F.collect_set("block").alias("_blocks"))


_WINDOW_ROWS = "bucket int, kind int, hashes binary, checks binary, texts binary, at binary, starts binary"
_WINDOW_NAMES = ["bucket", "kind", "hashes", "checks", "texts", "at", "starts"]
_WINDOW_TYPES = [pa.int32(), pa.int32()] + [pa.binary()] * 5


def _candidates(counts: np.ndarray, blocks: pa.Array, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows whose first whole grid block is an anchor."""
    text = np.repeat(np.arange(len(blocks)), np.diff(blocks.offsets.to_numpy()))
    number = blocks.flatten().to_numpy().astype(np.int64)
    start = (number * block)[:, None] - np.arange(block)[None, :]
    text = np.repeat(text, block).reshape(-1, block)
    good = (start >= 0) & (start <= (counts[text] - window))
    return text[good], start[good]


def _window_rows(chunk: ts.Chunk, keys: list[bytes], copies: np.ndarray, blocks: pa.Array, window: int, buckets: int) -> list[tuple]:
    words = ts.words(chunk)
    text, start = _candidates(words.counts, blocks, window, (window + 1) // 2)
    at = words.first[text] + start
    hashes = ts.grams(words.hashes, window)[at] if len(at) else np.zeros(0, np.uint64)
    checks = (ts.grams(words.hashes, window, step=0x8EBC6AF09C88C6E3)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    order = np.lexsort((checks, hashes))
    hashes, checks, text, start = hashes[order], checks[order], text[order], start[order]
    rows = []
    for b, own in by_bucket(hashes, 64, buckets):
        h, c = hashes[own], checks[own]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        # what this chunk has twice, or has in a text with copies, is repeated already
        group = np.cumsum(new) - 1
        often = np.bincount(group, np.minimum(copies[text[own]], 2)) > 1
        rows.append((b, 0, pack_sorted(h[new]), c[new].astype("<u4").tobytes(), None, None, None))
        if often.any():
            rows.append((b, 0, pack_sorted(h[new][often]), c[new][often].astype("<u4").tobytes(), None, None, None))
        named, where = np.unique(text[own], return_inverse=True)
        rows.append((b, 1, pack_sorted(h), c.astype("<u4").tobytes(), b"".join(keys[i] for i in named.tolist()),
                     where.astype("<u4").tobytes(), start[own].astype("<u4").tobytes()))
    return rows


_PAIR = np.dtype([("h", "<u8"), ("c", "<u4")])


def _pairs(hashes: bytes, checks: bytes) -> np.ndarray:
    values = unpack_sorted(hashes)
    out = np.empty(len(values), dtype=_PAIR)
    out["h"], out["c"] = values, np.frombuffer(checks, dtype="<u4")
    return out


def _counted(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, with their summed counts (2 at most)."""
    pairs, n = np.concatenate(parts), np.concatenate(counts)
    order = np.lexsort((pairs["c"], pairs["h"]))
    pairs, n = pairs[order], n[order]
    new = np.concatenate([[True], (pairs["h"][1:] != pairs["h"][:-1]) | (pairs["c"][1:] != pairs["c"][:-1])])
    return pairs[new], np.minimum(np.add.reduceat(n.astype(np.int64), np.flatnonzero(new)), 2).astype(np.uint8)


def _among(pairs: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which pairs are in the ascending ``repeated``; hashes that occur with several checks are rare."""
    if not len(repeated):
        return np.zeros(len(pairs), dtype=bool)
    low = np.searchsorted(repeated["h"], pairs["h"])
    hit = np.zeros(len(pairs), dtype=bool)
    live = np.flatnonzero(low < len(repeated))
    while len(live):
        live = live[repeated["h"][low[live]] == pairs["h"][live]]
        hit[live] |= repeated["c"][low[live]] == pairs["c"][live]
        low[live] += 1
        live = live[low[live] < len(repeated)]
    return hit


def repeated_windows(found: DataFrame, window: int, buckets: int) -> DataFrame:
    """(_key, _starts): windows of the texts in ``found`` (_key, _text, _copies, _blocks) that start elsewhere too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for chunk in ts.chunks(batch.column(1)):
                own = slice(chunk.first, chunk.first + chunk.count)
                blocks = pa.array(batch.column(3).slice(chunk.first, chunk.count).to_pylist(), pa.list_(pa.int32()))
                yield batch_of(_window_rows(chunk, keys[own], copies[own], blocks, window, buckets), _WINDOW_NAMES, _WINDOW_TYPES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket: the windows of all chunks, then their owners."""
        bucket, parts, counts, size, repeated = None, [], [], 0, None
        for batch in batches:
            for b, kind, hashes, checks, texts, at, starts in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    bucket, parts, counts, size, repeated = b, [], [], 0, None
                pairs = _pairs(hashes, checks)
                if kind == 0:
                    parts.append(pairs)
                    counts.append(np.ones(len(pairs), dtype=np.uint8))
                    size += len(pairs)
                    if size > 1 << 22:
                        one = _counted(parts, counts)
                        parts, counts, size = [one[0]], [one[1]], 0
                    continue
                if repeated is None:
                    distinct, n = _counted(parts, counts)
                    repeated, parts, counts = distinct[n > 1], [], []
                hit = np.flatnonzero(_among(pairs, repeated))
                where, start = np.frombuffer(at, dtype="<u4")[hit], np.frombuffer(starts, dtype="<u4")[hit]
                order = np.argsort(where, kind="stable")
                edges = 4 * np.searchsorted(where[order], np.arange(len(texts) // 16 + 1))
                flat = start[order].astype("<u4").tobytes()
                yield batch_of([(texts[16 * i:16 * i + 16], flat[edges[i]:edges[i + 1]])
                                for i in np.flatnonzero(np.diff(edges)).tolist()], ["_key", "starts"], [pa.binary(), pa.binary()])

    dealt = found.select("_key", "_text", "_copies", "_blocks").mapInArrow(emit, _WINDOW_ROWS).repartitionById(buckets, F.col("bucket"))
    met = dealt.sortWithinPartitions("bucket", "kind").mapInArrow(count, "_key binary, starts binary")
    return met.groupBy("_key").agg(F.collect_list("starts").alias("_starts"))


def _cut_text(raw: bytes, starts: np.ndarray, window: int) -> tuple[int, bytes]:
    """How many words go, and the others joined by spaces."""
    words = raw.split()
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover)[:-1] > 0
    return int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def _result_schema(with_text: bool) -> str:
    return "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                bucket_bytes: int = BUCKET_BYTES, with_text: bool = False) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    ts.bounded_batches(docs.sparkSession)
    given = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    keyed = given.withColumn("_key", F.unhex(F.md5("_text")))
    total = given.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bits = min(64, max(EDGE_BITS, int(total // 4).bit_length() + _SPREAD))
    anchored = anchors(keyed, window, bits, buckets)
    # copies meet here once per map task
    texts = keyed.groupBy("_key").agg(F.any_value("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
    found = cut(texts.join(anchored, "_key"), "anchored")
    size = found.agg(F.sum(F.size("_blocks").cast("long"))).first()[0] or 0
    windows = repeated_windows(found, window, max(1, -(-size * ((window + 1) // 2) * 8 // bucket_bytes)))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                gone, kept = _cut_text(value.as_buffer().to_pybytes(), np.frombuffer(b"".join(starts.as_py()), dtype="<u4").astype(np.int64), window)
                rows.append((name, gone, hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
            yield batch_of(rows, ["_key", "_gone", "_sha"] + ["_kept"] * with_text, [pa.binary(), pa.int64(), pa.string()] + [pa.string()] * with_text)

    cleaned = found.select("_key", "_text").join(windows, "_key").mapInArrow(
        remove, "_key binary, _gone long, _sha string" + (", _kept string" if with_text else ""))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, shas, texts = [], [], []
            for value in batch.column(2):
                words = value.as_buffer().to_pybytes().split()
                joined = b" ".join(words)
                n.append(len(words))
                shas.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined.decode())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []),
                                             ["_id", "_key", "n_words", "_whole"] + ["_all"] * with_text)

    kind = given.schema["_id"].dataType.simpleString()
    base = keyed.select("_id", "_key", "_text").mapInArrow(
        whole, f"_id {kind}, _key binary, n_words long, _whole string" + (", _all string" if with_text else ""))
    out = base.join(cleaned, "_key", "left").select(
        F.col("_id").alias(key), "n_words", F.coalesce("_gone", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("_sha", "_whole").alias("kept_sha256"), *([F.coalesce("_kept", "_all").alias("kept_text")] if with_text else []))
    return out
