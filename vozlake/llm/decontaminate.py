"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

A text is normalised to its lower-cased words with one space around each. The windows of all items, normalised the
same way, are the patterns. One pass over a normalised text finds every window that occurs in it, and word numbers lead
back to character offsets in the original.

The automaton is built once per worker. It is bounded: at most ``BLOCK_WINDOWS`` windows; a larger benchmark is cut into
blocks of windows by hash, and documents pass the blocks one after the other through stored stages.

Rows: a null text (document or item) has no words; a null item id counts as the empty string, items that share an id count
as one; keys of documents may repeat or be null; either table may be empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vozlake.durable import cut
from vozlake.llm import textscan as ts

WINDOW = 10
#: windows of one automaton (about 2 kB each in a worker)
BLOCK_WINDOWS = 40_000

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if ts.ALNUM[b] else 32 for b in range(256))
_automata: dict[tuple[int, int], tuple] = {}


def normalise(raw: bytes) -> str:
    """`` w1 w2 ... `` of a text, or the empty string."""
    found = raw.translate(_TO_WORDS).split()
    return f" {b' '.join(found).decode()} " if found else ""


def windows(benchmark: DataFrame, item: str = "item_id", texts: Sequence[str] = ("text",), n: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window with the ids of the items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name, *values in zip(*(c.to_pylist() for c in batch.columns)):
                for value in values:
                    w = normalise((value or "").encode()).split()
                    own = {" ".join(w[i:i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()
                    found += [f" {x} " for x in own]
                    names += [name] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["item", "window"])

    given = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), *[F.col(c).cast("string") for c in texts])
    given = given.toDF("item", *[f"text{i}" for i in range(len(texts))])
    return given.mapInArrow(run, "item string, window string").groupBy("window").agg(
        F.array_sort(F.collect_set("item")).alias("items"))


def _automaton(sent, block: int):
    """The automaton of a broadcast list of windows, kept by the worker."""
    import ahocorasick

    if (sent.id, block) not in _automata:
        _automata.clear()
        built = ahocorasick.Automaton()
        for i, (window, _) in enumerate(sent.value):
            built.add_word(window, i)
        built.make_automaton()
        _automata[sent.id, block] = built, [len(w) for w, _ in sent.value], [items for _, items in sent.value]
    return _automata[sent.id, block]


class _Sent:
    """A broadcast with a name that is the same in every task."""

    def __init__(self, broadcast, name: str) -> None:
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_texts: Sequence[str] = ("text",), n: int = WINDOW, keep: Sequence[str] = ()) -> DataFrame:
    """Per document: key, ``keep`` columns, n_words, n_hit, items (sorted ids) and spans of hit words as
    code-point offsets in the original text (end exclusive)."""
    import uuid

    ts.bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    stored = cut(windows(benchmark, item, item_texts, n), "windows")
    blocks = max(1, -(-stored.count() // BLOCK_WINDOWS))
    of_block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    name = uuid.uuid4().hex
    empty = F.array().cast("array<struct<start:int,end:int>>")
    work = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
                       F.lit(0).cast("long").alias("n_words"), empty.alias("_hits"), F.array().cast("array<string>").alias("_items"))
    for block in range(blocks):
        # bounded by BLOCK_WINDOWS, as the hash spreads them
        rows = stored.filter(of_block == block).collect()
        sent = _Sent(spark.sparkContext.broadcast([(r.window, r["items"]) for r in rows]), f"{name}-{block}")
        step = _pass(work, sent, block)
        if block < blocks - 1:
            work = cut(work.mapInArrow(step, work.schema), "contamination")
    # in one function, so that a task has one Python worker
    found = work.mapInArrow(lambda batches: _spans(step(batches)), ", ".join(f"`{c}` {t}" for c, t in work.dtypes if c not in ("_text", "_hits"))
                            + ", n_hit long, spans array<struct<start:int,end:int>>")
    return found.select(F.col("_key").alias(key), *[F.col(f"_keep_{c}").alias(c) for c in keep], "n_words", "n_hit",
                        F.array_sort(F.array_distinct("_items")).alias("items"), "spans")


def _pass(work: DataFrame, sent: _Sent, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What adds the hits of one automaton, as ranges of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, lengths, items = _automaton(sent, block)
        for batch in batches:
            raw = pc.fill_null(batch.column("_text"), "").cast(pa.binary())
            n_words, hits, found = [], [], []
            for value, had, had_items in zip(raw, batch.column("_hits"), batch.column("_items")):
                normal = normalise(value.as_buffer().to_pybytes())
                n_words.append(max(normal.count(" ") - 1, 0))
                matched = list(built.iter(normal)) if len(built) and normal else []
                own, names = had.as_py(), had_items.as_py()
                if matched:
                    points = np.frombuffer(normal.encode("utf-32-le"), dtype="<u4")
                    spaces = np.flatnonzero(points == 32)
                    which = np.array([i for _, i in matched])
                    last = np.array([end for end, _ in matched])
                    begin = np.searchsorted(spaces, last - np.array(lengths)[which] + 1)
                    own += _merged(begin, np.searchsorted(spaces, last))
                    names += sorted({x for i in set(which.tolist()) for x in items[i]})
                hits.append(own)
                found.append(names)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in plain), pa.array(n_words, pa.int64()),
                pa.array(hits, batch.column("_hits").type), pa.array(found, pa.list_(pa.string())),
            ], [*plain, "n_words", "_hits", "_items"])

    plain = [c for c in work.columns if c not in ("n_words", "_hits", "_items")]
    return run


def _merged(begin: np.ndarray, end: np.ndarray) -> list[dict]:
    """Disjoint ranges that cover the same words."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    last = np.append(first[1:], len(begin)) - 1
    return [{"start": int(begin[a]), "end": int(end[b])} for a, b in zip(first, last)]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ranges of words to counts and to code points of the original."""
    for batch in batches:
        counts, spans = [], []
        for value, ranges in zip(pc.fill_null(batch.column("_text"), ""), batch.column("_hits").to_pylist()):
            if not ranges:
                counts.append(0)
                spans.append([])
                continue
            both = _merged(np.array([r["start"] for r in ranges]), np.array([r["end"] for r in ranges]))
            data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
            starts, ends = ts.spans(ts.Chunk(0, data, np.array([0, data.size])), ts.ALNUM)
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            counts.append(sum(r["end"] - r["start"] for r in both))
            spans.append([{"start": int(point[starts[r["start"]]]), "end": int(point[ends[r["end"] - 1]])} for r in both])
        rest = [c for c in batch.schema.names if c not in ("_text", "_hits")]
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in rest), pa.array(counts, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ], [*rest, "n_hit", "spans"])


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The per-document digest columns of :func:`contamination`."""
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
