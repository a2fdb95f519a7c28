"""Best-fit packing of token pieces into fixed-length sequences, planned on a histogram of lengths.

Packing is decided on counts: how many pieces there are of each length, at most ``capacity``
numbers whatever the size of the corpus. The plan gives every rank within a length its place, so a
piece only needs its rank. Ranks come from the order in which tasks met the pieces (kept in a stored
stage) and the running count of earlier tasks; no length is gathered in one task.

Rows: a null text is an empty text and still has its end token; repeated and null keys are separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vozlake.durable import cut
from vozlake.llm import textscan as ts, tokens

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
           end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Stored stage: one row per piece of each document, with its rank among the pieces of its length
    in its task (``_part``, ``_rank``). Of a document above ``capacity`` the first piece is the short one."""
    ts.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{ts.quoted(key)} {kind}, piece int, start long, length long, ids_crc32 long, _part int, _rank long"
    schema += ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.of_worker(vocabulary)
        part = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            keys = batch.column(0)
            for first, ids, counts in tokenizer.texts(batch.column(1), end_id):
                n_pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n_pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                head = counts - (n_pieces - 1) * capacity
                length = np.where(number == 0, head[doc], capacity)
                start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
                begin = (np.cumsum(counts) - counts)[doc] + start
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                bounds = list(zip((4 * begin).tolist(), (4 * (begin + length)).tolist()))
                rank = _ranks(length, met)
                columns = [
                    keys.slice(first, len(counts)).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start),
                    pa.array(length), pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64()),
                    pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank),
                ]
                names = [key, "piece", "start", "length", "ids_crc32", "_part", "_rank"]
                if with_ids:
                    columns.append(pa.array([bytes(raw[a:b]) for a, b in bounds], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut(docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema), "pieces")


def _ranks(length: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Number of earlier pieces of the same length; ``met`` carries the counts on."""
    order = np.argsort(length, kind="stable")
    sorted_length = length[order]
    begin = np.searchsorted(sorted_length, sorted_length)
    rank = np.empty(len(length), dtype=np.int64)
    rank[order] = np.arange(len(length)) - begin + met[sorted_length]
    np.add.at(met, length, 1)
    return rank


@dataclass(frozen=True)
class Plan:
    """Stretches of ranks by length: ranks ``low`` on go ``each`` to a sequence, from ``sequence`` on, at ``offset``."""

    first: np.ndarray  # by length: where its stretches begin
    low: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Best fit, longest first, over ``counts[length]``.

    Sequences filled alike are one group (first number, how many). A group with room for k more pieces
    takes k for each of its sequences at once. Each length splits one group at most, and a visit at least
    halves a group's room, so there are at most 11 stretches for each of 2 * capacity groups.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rows: list[tuple[int, int, int, int, int]] = []
    total = 0
    for length in range(capacity, 0, -1):
        left, low = int(counts[length]), 0

        def fill(sequence: int, number: int, room: int) -> int:
            """Put what is left into these sequences; returns how many pieces went."""
            nonlocal low
            k = room // length
            went = min(left, number * k)
            rows.append((length, low, k, sequence, capacity - room))
            full, rest = divmod(went, k)
            if full:
                rooms[room - k * length].append((sequence, full))
            if rest:
                rooms[room - rest * length].append((sequence + full, 1))
            used = full + (rest > 0)
            if number > used:
                rooms[room].append((sequence + used, number - used))
            low += went
            return went

        room = length
        while left and room <= capacity:
            groups, rooms[room] = rooms[room], []
            while groups and left:
                sequence, number = groups.pop()
                left -= fill(sequence, number, room)
            rooms[room].extend(groups)
            room += 1
        if left:
            number = -(-left // (capacity // length))
            left -= fill(total, number, capacity)
            total += number
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    return Plan(first, *(np.ascontiguousarray(table[:, i]) for i in (1, 2, 3, 4)), total)


def place(staged: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of :func:`pieces` with sequence_id and offset."""
    spark = staged.sparkSession
    per_task = staged.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in staged.groupBy("length").count().collect():  # one row per length
        counts[row[0]] = row[1]
    planned = spark.sparkContext.broadcast(plan(counts, capacity))
    ranked = staged.join(base, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    kept = [c for c in staged.columns if c not in ("_part", "_rank")]
    ranked = ranked.select(*kept, "_rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planned.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for value in np.unique(length):
                mine = length == value
                a, b = p.first[value], p.first[value + 1]
                at[mine] = a + np.searchsorted(p.low[a:b], rank[mine], side="right") - 1
            step, slot = np.divmod(rank - p.low[at], p.each[at])
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(p.sequence[at] + step), pa.array(p.offset[at] + slot * length)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
         end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place; ``with_ids`` adds their ids as little-endian 32-bit integers."""
    return place(pieces(docs, key, text, vocabulary, end_id, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (``with_ids``): sequence_id, length, ids. A sequence is a bounded group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts")).select(
        "sequence_id", "length",
        F.aggregate("_parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
