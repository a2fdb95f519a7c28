"""Token files: ids ranked by frequency, in a byte-aligned variable-length code with control bytes apart.

A frequent id gets a small rank, and a rank takes as many bytes as it needs (1 to 4). Two control bits
give that number, four ids to a control byte; control and data bytes are separate streams. To decode, numpy
looks the control bytes up in a table of four lengths, sums them to offsets and gathers the data bytes.

The file format is a Parquet table of blocks written by Spark's own committer, so a lost task is written again:
shard, block, doc_ids, lengths, n_ids, base (ids before it in its shard), control, data. Shards are ranges of the key
in ascending order (nulls first) and blocks follow each other in a shard. A second table has the id of each rank.

Rows: a null text is empty and has its end token only; rows of one key follow each other in any order; an empty
table makes empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vozlake.durable import cut, scratch
from vozlake.llm import textscan as ts, tokens

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: ids in a block, unless one document has more
BLOCK_IDS = 1 << 20

#: the four code lengths that each control byte stands for
LENGTHS = (((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[:len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    taken = np.arange(4) < size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[taken].tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values that :func:`encode` was given."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(size, dtype=np.int64)
    begins = ends - size
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(count, dtype=np.uint32)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= raw[begins[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class TokenFiles:
    """Where the two tables are."""

    blocks: str
    ranks: str


def tokenised(docs: DataFrame, key: str, text: str, vocabulary: str, end_id: int) -> DataFrame:
    """Stored stage: ids of each document (32-bit or, if the vocabulary allows, 16-bit), and its place in its task."""
    ts.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.of_worker(vocabulary)
        part, met = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, counts in tokenizer.texts(batch.column(1), end_id):
                raw, ends = np.ascontiguousarray(ids, dtype=_width(tokenizer)), np.cumsum(counts)
                width = raw.itemsize
                view = memoryview(raw).cast("B")
                values = [bytes(view[width * (e - n):width * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(counts)), pa.array(counts), pa.array(values, pa.binary()),
                    pa.array(np.full(len(counts), part), pa.int32()), pa.array(met + np.arange(len(counts))),
                ], ["key", "n", "ids", "part", "pos"])
                met += len(counts)

    return cut(docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        run, f"key {kind}, n long, ids binary, part int, pos long"), "tokens")


def _width(tokenizer: tokens.PieceTokenizer) -> str:
    return "<u2" if tokenizer.library.get_vocab_size() <= 1 << 16 else "<u4"


def frequencies(staged: DataFrame, vocabulary: str) -> DataFrame:
    """(id, n) over all documents; each task sends one row per id that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, total = _width(tokens.of_worker(vocabulary)), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                seen = np.bincount(np.frombuffer(value.as_buffer(), dtype=width))
                if len(seen) > len(total):
                    total, seen = seen, total
                total[:len(seen)] += seen
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["id", "n"])

    return staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
          end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> TokenFiles:
    """Tokenise, rank, encode and write all documents in ascending order of ``key``."""
    spark = docs.sparkSession
    files = TokenFiles(f"{path}/blocks", f"{path}/ranks")
    staged = tokenised(docs, key, text, vocabulary, end_id)
    # a row per id of the vocabulary at most
    by_count = frequencies(staged, vocabulary).collect()
    order = [r.id for r in sorted(by_count, key=lambda r: (-r.n, r.id))]
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(files.ranks)
    rank_of = np.zeros(max(order, default=0) + 1, dtype=np.uint32)
    rank_of[order] = np.arange(len(order))
    sent = spark.sparkContext.broadcast(rank_of)

    kind = staged.schema["key"].dataType.simpleString()
    order_cols = [F.col("key").asc_nulls_first(), F.col("part"), F.col("pos")]
    # ids travel as they are and are coded where a shard is written, so finding the ranges codes nothing
    ranged = staged.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, table = _width(tokens.of_worker(vocabulary)), sent.value
        shard, number, base = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, base, held, size
            control, data = encode(table[np.frombuffer(b"".join(raw for *_, raw in held), dtype=width)])
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([number], pa.int32()),
                pa.array([[k for k, *_ in held]], pa.list_(key_type)), pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())),
                pa.array([size], pa.int64()), pa.array([base], pa.int64()),
                pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ], ["shard", "block", "doc_ids", "lengths", "n_ids", "base", "control", "data"])
            number, base, held, size = number + 1, base + size, [], 0
            return row

        for batch in batches:
            key_type = batch.column("key").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "ids"))):
                if held and size + row[1] > block_ids:
                    yield block()
                held.append(row)
                size += row[1]
        if held:
            yield block()

    ranged.mapInArrow(
        blocks, f"shard int, block int, doc_ids array<{kind}>, lengths array<long>, n_ids long, base long, control binary, data binary"
    ).write.parquet(files.blocks)
    return files


def read(spark: SparkSession, files: TokenFiles, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """From the files: each document's key, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked
    for, its ids as little-endian 32-bit integers."""
    stored = spark.read.parquet(files.blocks)
    ranks = spark.read.parquet(files.ranks).collect()  # a row per id of the vocabulary at most
    ids = np.zeros(len(ranks), dtype="<u4")
    for rank, token in ranks:
        ids[rank] = token
    sent = spark.sparkContext.broadcast(ids)
    # one row per shard: a window over all of them is small
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = stored.join(F.broadcast(starts), "shard").select(
        "doc_ids", "lengths", "control", "data", (F.col("_start") + F.col("base")).alias("start"))
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                ranks = decode(batch.column("control")[i].as_py(), batch.column("data")[i].as_py(), int(ends[-1]))
                view = memoryview(table[ranks]).cast("B")
                cuts = list(zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist()))
                columns = [
                    batch.column("doc_ids")[i].values, pa.array(batch.column("start")[i].as_py() + ends - lengths),
                    pa.array(lengths), pa.array([zlib.crc32(view[a:b]) for a, b in cuts], pa.int64()),
                ]
                names = [key, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(view[a:b]) for a, b in cuts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(
        run, f"{ts.quoted(key)} {kind}, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write token files below the shared folder and read them back."""
    return read(docs.sparkSession, write(docs, scratch(docs.sparkSession, "tokenfiles"), **options), options.get("key", "doc_id"))
