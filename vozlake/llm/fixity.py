"""Merkle fixity audit of WARC replicas.

Records are hashed where they are read, and only hashes travel. A tree over each archive combines them by ordered offset ranges:
64 KiB, 1 MiB, 16 MiB, 256 MiB and the archive, each the hash of its children in order. Replicas are compared root by root; only
mismatching branches are followed down, level by level, to the records that differ, and these are lined up again.

Archives are gzip WARC files written by Spark's own committer (:func:`write_warc`), one or more per partition of at most
``FILE_RECORDS`` records; a file is read as one value, so it must stay below 2 GB.

Rows of :func:`write_warc`: null ids, addresses and bodies are written as empty; line breaks in an address become spaces; repeated rows
are separate records; other columns are ignored. Rows of :func:`audit`: a null archive is the archive named "", a null offset is -1, other
nulls count as a value of their own; repeated rows of one offset are counted, so one copy more is a difference; two empty replicas agree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vozlake.durable import cut

FILE_RECORDS = 4_000
#: bits of offset below each level; above the last is the archive itself
LEVELS = (16, 20, 24, 28)
RECORD_SCHEMA = "archive string, offset long, length long, record_id string, sha256 string"


def record_text(record_id: Column, address: Column, body: Column) -> Column:
    """One WARC record without its final blank lines."""
    clean = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    payload = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:record:"), clean(record_id),
        F.lit(">\r\nWARC-Target-URI: "), clean(address), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
               file_records: int = FILE_RECORDS) -> str:
    """Write the rows, in their order and partitions, as WARC files below ``path``."""
    pages.select(record_text(F.col(key), F.col(url), F.col(html)).alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").option("maxRecordsPerFile", file_records).text(path)
    return path


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[int, int, str, str]]:
    """(offset, length, record id, SHA-256) of the records of an uncompressed stream, holding one record at a time.

    Bytes that don't begin a record, up to the next that do, and a cut-off end are records without an id."""
    held, offset, pieces = bytearray(), 0, iter(pieces)

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while need(1):
        name, size = "", 0
        if need(5) and held[:5] == b"WARC/":
            end = held.find(b"\r\n\r\n")
            while end < 0 and need(len(held) + 1):
                end = held.find(b"\r\n\r\n")
            if end >= 0:
                fields = dict(line.split(b": ", 1) for line in bytes(held[:end]).split(b"\r\n")[1:] if b": " in line)
                length = fields.get(b"Content-Length", b"")
                if length.isdigit():
                    name = fields.get(b"WARC-Record-ID", b"").decode("utf-8", "replace")
                    size = end + 4 + int(length) + 4
                    need(size)
        if not size:  # look for the next record
            at = held.find(b"\r\n\r\nWARC/")
            while at < 0 and need(len(held) + 1):
                at = held.find(b"\r\n\r\nWARC/")
            size = at + 4 if at >= 0 else len(held)
        size = min(size, len(held))
        yield offset, size, name, hashlib.sha256(memoryview(held)[:size]).hexdigest()
        offset += size
        held = held[size:]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Hashed records (``RECORD_SCHEMA``) of all WARC files below ``path``; an archive is named by its place in the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"^(part-\d+)-.*?(-c\d+)?\.txt\.gz$", "$1$2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(parse_warc(_inflated(content.as_buffer())))
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([archive] * len(rows), pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()),
                ], ["archive", "offset", "length", "record_id", "sha256"])

    return files.select(name.alias("archive"), "content").mapInArrow(run, RECORD_SCHEMA)


def _inflated(raw: pa.Buffer, step: int = 1 << 16) -> Iterator[bytes]:
    view, rest = memoryview(raw), b""
    unzip = zlib.decompressobj(31)
    for at in range(0, len(view), step):
        rest = bytes(view[at:at + step])
        while rest:
            yield unzip.decompress(rest)
            rest = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def tree(records: DataFrame) -> DataFrame:
    """Stored nodes (archive, level, node, hash): level 0 is an offset, the last level the archive.

    What is at one offset is combined by sums of hash parts, so it may be any number of rows; a range has at most 65 536
    offsets, or 16 ranges, below it."""
    whole = _identity()
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    nodes = records.select(F.coalesce("archive", F.lit("")).alias("archive"), F.coalesce("offset", F.lit(-1)).alias("node"), whole.alias("_h"))
    nodes = nodes.groupBy("archive", "node").agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[part(i) for i in range(4)]), 256).alias("hash"))
    built = [cut(nodes.select("archive", F.lit(0).alias("level"), "node", "hash"), "tree")]
    below = 0
    for level, bits in enumerate((*LEVELS, 63), 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        parents = built[-1].groupBy("archive", F.shiftright("node", bits - below).alias("node")).agg(
            F.sha2(F.array_join(F.transform(children, lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"])), "|"), 256).alias("hash"))
        built.append(cut(parents.select("archive", F.lit(level).alias("level"), "node", "hash"), "tree"))
        below = bits
    out = built[0]
    for more in built[1:]:
        out = out.unionByName(more)
    return out


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Offsets (archive, node) at which two trees differ, found from the roots down."""
    steps = (0, *LEVELS, 63)
    suspects = None
    for level in range(len(steps) - 1, -1, -1):
        sides = []
        for side in (left, right):
            nodes = side.filter(F.col("level") == level).select("archive", "node", "hash")
            if suspects is not None:
                up = F.shiftright("node", steps[level + 1] - steps[level])
                nodes = nodes.withColumn("_up", up).join(suspects, ["archive", "_up"], "left_semi").drop("_up")
            sides.append(nodes)
        other = sides[1].withColumnRenamed("hash", "_other")
        found = sides[0].join(other, ["archive", "node"], "full").filter(~F.col("hash").eqNullSafe(F.col("_other")))
        found = cut(found.select("archive", "node"), "suspects")
        suspects = found.withColumnRenamed("node", "_up")
    return found


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record that differs, and one per distance over which equal records of an archive have moved.

    Columns: archive, offset, found_offset, status, records (how many), record_id, length, expected and found SHA-256. Below the
    mismatching branches records are lined up again, so that a change of length is one difference and not one per record after it:

    * ``moved``: equal records that both replicas have as often, at other offsets; ``records`` of them by ``found_offset - offset``;
    * ``corrupt``: of what is left, a record whose id is the only one of that name on either side, else the only one at its offset;
    * ``missing`` and ``extra``: the others. Copies of one record at one offset are one row, which counts those too few or too many."""
    sides = [cut(r.select("archive", "offset", "length", "record_id", "sha256"), "records") for r in (records, replica)]
    wrong = mismatches(tree(sides[0]), tree(sides[1])).withColumnRenamed("node", "offset")
    name = ["archive", "offset", "length", "record_id", "sha256"]
    found = None
    for k, side in enumerate(sides):
        keyed = side.withColumns({"archive": F.coalesce("archive", F.lit("")), "offset": F.coalesce("offset", F.lit(-1))})
        keyed = keyed.join(wrong, ["archive", "offset"], "left_semi").select(*name, F.lit(1 - k).alias("_ours"), F.lit(k).alias("_theirs"))
        found = keyed if found is None else found.unionByName(keyed)
    counted = found.groupBy(*name).agg(F.sum("_ours").alias("_ours"), F.sum("_theirs").alias("_theirs"))
    counted = cut(counted.filter("_ours <> _theirs").withColumn("_same", _identity()), "counted")

    alike = counted.groupBy("archive", "_same").agg(
        F.sum("_ours").alias("records"), F.sum("_theirs").alias("_n"), F.min(F.when(F.col("_ours") > 0, F.col("offset"))).alias("offset"),
        F.min(F.when(F.col("_theirs") > 0, F.col("offset"))).alias("found_offset")).filter("records = _n")
    empty = F.lit(None).cast("string")
    moved = alike.groupBy("archive", (F.col("found_offset") - F.col("offset")).alias("_by")).agg(
        F.min("offset").alias("offset"), F.sum("records").alias("records")).select(
        "archive", "offset", (F.col("offset") + F.col("_by")).alias("found_offset"), F.lit("moved").alias("status"), "records",
        empty.alias("record_id"), F.lit(None).cast("long").alias("length"), empty.alias("expected_sha256"), empty.alias("found_sha256"))
    rest = cut(counted.join(alike, ["archive", "_same"], "left_anti").drop("_same"), "changed")

    out = moved
    for key in ("record_id", "offset"):
        pairs = _pairs(rest, key)
        out = out.unionByName(pairs.select(
            "archive", "_a.offset", F.col("_b.offset").alias("found_offset"), F.lit("corrupt").alias("status"), F.lit(1).cast("long").alias("records"),
            F.coalesce("_a.record_id", "_b.record_id").alias("record_id"), F.coalesce("_a.length", "_b.length").alias("length"),
            F.col("_a.sha256").alias("expected_sha256"), F.col("_b.sha256").alias("found_sha256")))
        left = rest.join(pairs.select("archive", key), ["archive", key], "left_anti")
        rest = cut(left, "changed") if key == "record_id" else left
    ours, theirs = F.col("_ours") > 0, F.col("_theirs") > 0
    return out.unionByName(rest.select(
        "archive", F.when(ours, F.col("offset")).alias("offset"), F.when(theirs, F.col("offset")).alias("found_offset"),
        F.when(F.col("_ours") > F.col("_theirs"), "missing").otherwise("extra").alias("status"), F.abs(F.col("_ours") - F.col("_theirs")).alias("records"),
        "record_id", "length", F.when(ours, F.col("sha256")).alias("expected_sha256"), F.when(theirs, F.col("sha256")).alias("found_sha256")))


def _identity() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.sha2(F.concat_ws("|", text("length"), text("record_id"), text("sha256")), 256)


def _pairs(rest: DataFrame, key: str) -> DataFrame:
    """(archive, key, _a, _b) where each replica has one record only under a name or at an offset; an empty name is none."""
    record = F.struct("offset", "record_id", "length", "sha256")
    sides = [F.when((F.col(c) == 1) & (F.col(other) == 0), record) for c, other in (("_ours", "_theirs"), ("_theirs", "_ours"))]
    groups = rest.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy("archive", key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(sides[0]).alias("_a"), F.min(sides[1]).alias("_b"))
    return groups.filter("_n = 2 AND _a IS NOT NULL AND _b IS NOT NULL").select("archive", key, "_a", "_b")
