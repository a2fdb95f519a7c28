"""Near duplicates by SimHash: fingerprints link at a Hamming distance of at most ``distance``; components of links are the classes.

The search is a hierarchical index over fingerprints in Gray order. Neighbours in that order share most bits, so blocks of
them are factored: a node holds the bit positions in which all its fingerprints agree (its mask) and their values (its
pattern), less what the nodes above it hold already. A fingerprint that looks for partners walks down from the top, adds up its
differences from each node's own bits, and leaves a whole group as soon as they exceed ``distance``. A leaf has the remaining bits,
so the sum there is the exact distance.

The index is built in distance + 1 orders, each led by another band of bits. Two fingerprints that link agree in at least one
band, so a top node need only be entered by fingerprints that agree with all of its band: such a group (mask, value) is what is dealt
to tasks. A group of more than GROUP_CODES fingerprints is dealt again by bands of its other bits in the same way, so its size is bounded
and no pair is lost, however alike the fingerprints are. Inside a group the order's neighbours are linked first, and a
group of which all members are in the asker's class is left at once, so a dense family costs about one step a member, not all
its pairs. A group returns at most one link per member.

Equal fingerprints are one entry with the least key, found by combinable minima. No fingerprint leaves for the driver.

Rows: a null text, or one without words, has fingerprint zero, linked like any other; one of fewer words than a shingle has its whole
sequence as its one shingle. Keys may repeat; a null key counts as larger than all others; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vozlake.durable import cut
from vozlake.llm import textscan as ts
from vozlake.llm.components import components
from vozlake.llm.dealing import attach

WORDS, DISTANCE, SEED = 4, 4, 42
#: fingerprints of a group that is searched in one go
GROUP_CODES = 8192
#: members of a node
FANOUT = 8
#: fingerprints that ask at once, and steps of their walk held at once
ASKERS, STEPS = 1024, 1 << 20
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits that more than half of the shingles' hashes have."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *(e + 1 for e in ends[:-1])]
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:])], dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Stored stage: _id and _code (the fingerprint's 64 bits as a signed number) of each document."""
    given = docs.select(F.col(ts.quoted(key)).alias("_id"), F.col(ts.quoted(text)).cast("string").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(1)):
                codes = np.array([fingerprint(chunk.text(i), words) for i in range(chunk.count)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.count), pa.array(codes.view(np.int64))], ["_id", "_code"])

    return cut(given.mapInArrow(run, f"_id {kind}, _code long"), "fingerprints")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order in which neighbouring numbers differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order, the leaves first."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        every, some = [self.codes], [self.codes]  # bits that all, and that any, of a node's fingerprints have
        while len(every[-1]) > 1:
            firsts = np.arange(0, len(every[-1]), FANOUT)
            every.append(np.bitwise_and.reduceat(every[-1], firsts))
            some.append(np.bitwise_or.reduceat(some[-1], firsts))
        masks = [~(a ^ b) for a, b in zip(every, some)]
        above = [np.repeat(m, FANOUT)[:len(masks[k])] for k, m in enumerate(masks[1:])] + [np.zeros(1, np.uint64)]
        self.own = [m & ~u for m, u in zip(masks, above)]
        self.pattern = [a & o for a, o in zip(every, self.own)]
        #: last fingerprint of each node
        n = len(self.codes)
        self.last = [np.minimum((np.arange(len(m)) + 1) * FANOUT ** k, n) - 1 for k, m in enumerate(masks)]

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """The class of each node of which all fingerprints are in one, else -1."""
        low, high = [labels], [labels]
        for level in self.own[:-1]:
            firsts = np.arange(0, len(level), FANOUT)
            low.append(np.minimum.reduceat(low[-1], firsts))
            high.append(np.maximum.reduceat(high[-1], firsts))
        return [np.where(a == b, a, -1) for a, b in zip(low, high)]

    def near(self, askers: np.ndarray, distance: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asker, later fingerprint) within the distance; fingerprints of nodes all in the asker's class are left out."""
        classes = self.uniform(labels)
        top = len(self.own) - 1
        stack = [(top, askers, np.zeros(len(askers), np.int64), np.zeros(len(askers), np.int64))]
        while stack:
            level, who, node, apart = stack.pop()
            if len(who) > STEPS // FANOUT:
                half = len(who) // 2
                stack += [(level, who[s], node[s], apart[s]) for s in (slice(half, None), slice(half))]
                continue
            unlike = (self.codes[who] & self.own[level][node]) ^ self.pattern[level][node]
            apart = apart + np.bitwise_count(unlike)
            stay = (apart <= distance) & (self.last[level][node] > who) & (classes[level][node] != labels[who])
            who, node, apart = who[stay], node[stay], apart[stay]
            if not len(who):
                continue
            if level == 0:
                yield who, node
                continue
            below = len(self.own[level - 1])
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            real = child < below
            stack.append((level - 1, np.repeat(who, FANOUT)[real], child[real], np.repeat(apart, FANOUT)[real]))

    def classes(self, distance: int) -> np.ndarray:
        """The component of each fingerprint, as the place of one of its members."""
        n = len(self.codes)
        step = np.bitwise_count(self.codes[1:] ^ self.codes[:-1])
        labels = np.maximum.accumulate(np.where(np.concatenate([[True], step > distance]), np.arange(n), 0))
        for first in range(0, n, ASKERS):
            parent: dict[int, int] = {}

            def root(a: int) -> int:
                while parent.get(a, a) != a:
                    parent[a] = parent.get(parent[a], parent[a])
                    a = parent[a]
                return a

            for who, met in self.near(np.arange(first, min(first + ASKERS, n)), distance, labels):
                joined = np.unique(np.stack([labels[who], labels[met]], axis=1), axis=0)
                for a, b in joined.tolist():
                    a, b = root(a), root(b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            if parent:
                moved = np.arange(n)
                moved[list(parent)] = [root(a) for a in list(parent)]
                labels = moved[labels]
        return labels


def bands(free: int, parts: int) -> list[int]:
    """Masks that cut the bits of ``free`` into ``parts`` of nearly equal size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(bits[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Each row of (_mask, _code) in one group more per band of the bits that its mask leaves free."""
    finer = [(_signed(mask), _signed(mask | band)) for mask in masks for band in bands(_ALL & ~mask, distance + 1)]
    # masks of a depth are few: each depth has distance + 1 times as many at most, and leaves fewer bits
    steps = rows.sparkSession.createDataFrame(finer, "_mask long, _finer long")
    wide = rows.join(F.broadcast(steps), "_mask").select(F.col("_finer").alias("_mask"), "_code")
    return wide.select("_mask", F.col("_mask").bitwiseAND(F.col("_code")).alias("_value"), "_code")


def groups(codes: DataFrame, distance: int = DISTANCE, limit: int = GROUP_CODES) -> DataFrame:
    """Stored stage: (_mask, _value, _code), the groups in which each pair within the distance meets at least once."""
    masks, done = [0], None
    live = cut(_dealt(codes.select(F.lit(0).cast("long").alias("_mask"), "_code"), masks, distance), "dealt")
    while True:
        big = cut(live.groupBy("_mask", "_value").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("_mask", "_value"), "large")
        masks = [m & _ALL for (m,) in big.select("_mask").distinct().collect()]  # of a short list of masks fixed above
        if not masks:
            return live if done is None else done.unionByName(live)
        small = cut(live.join(big, ["_mask", "_value"], "left_anti"), "dealt")
        done = small if done is None else done.unionByName(small)
        live = cut(_dealt(live.join(big, ["_mask", "_value"], "left_semi"), masks, distance).distinct(), "dealt")


def links(dealt: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(src, dst): each fingerprint of a group with the least one of its class there."""

    def solve(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = GrayIndex(codes)
        signed, labels = index.codes.view(np.int64), index.classes(distance)
        least = np.full(len(codes), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, signed)
        other = signed != least[labels]
        return signed[other], least[labels][other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group."""
        now, parts = None, []

        def closed() -> pa.RecordBatch:
            codes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            src, dst = solve(codes) if len(codes) > 1 else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

        for batch in batches:
            mask, value, codes = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(codes)]):
                if low == high:
                    continue
                group = int(mask[low]), int(value[low])
                if group != now:
                    yield closed()
                    now, parts = group, []
                parts.append(codes[low:high].view(np.uint64))
        yield closed()

    sorted_rows = dealt.repartition("_mask", "_value").sortWithinPartitions("_mask", "_value")
    return sorted_rows.mapInArrow(run, "src long, dst long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE,
            limit: int = GROUP_CODES) -> DataFrame:
    """Per document: key, fingerprint (16 hex digits) and component_id, the least key that links reach."""
    ts.bounded_batches(docs.sparkSession)
    rows = fingerprints(docs, key, text, words)
    codes = cut(rows.groupBy("_code").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")), "codes")
    named = components(links(groups(codes, distance, limit), distance))
    labelled = codes.join(named, codes["_code"] == named["node"], "left").select(
        "_code", "_least", "_n", F.coalesce("component", "_code").alias("_label"))
    least = labelled.groupBy("_label").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    of_code = attach(labelled.withColumnRenamed("_n", "_copies"), least, "_label").select("_code", "component_id", F.col("_copies").alias("_n"))
    return attach(rows, cut(of_code, "classes"), "_code").select(
        F.col("_id").alias(key), F.lower(F.lpad(F.hex("_code"), 16, "0")).alias("fingerprint"), "component_id")
