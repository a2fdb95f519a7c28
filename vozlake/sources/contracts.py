"""Dataset contracts: shape, completeness, distributions, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vozlake.functions import text as tx

RANGE_BYTES = 16 << 20
#: files up to this size are read as one value by the JVM; longer ones piece by piece, through the file systems that Arrow knows
WHOLE_BYTES = 256 << 20
_PIECE = 1 << 20
_ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def benchmark_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: exact ordered columns, no nulls, not empty."""
    in_order = list(df.columns) == list(columns)
    gaps = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    return df.agg(F.count(F.lit(1)).alias("rows"), gaps.alias("null_cells")).select(
        F.lit(in_order).alias("columns_ok"), "rows", "null_cells",
        (F.lit(in_order) & (F.col("rows") > 0) & (F.col("null_cells") == 0)).alias("ok"))


def dataset_contract(df: DataFrame, key: str, text: str, label: str, origin: str, rows: int | Column,
                     shares: Mapping[str, int | Column], constant: str, min_chars: int = 2) -> DataFrame:
    """(check, observed, expected, ok): size, unique key, text, class counts, constant origin.

    Keys are counted per value first, so uniqueness never needs a global distinct
    set in one task.
    """
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length(tx.prepared(F.col(text))) < min_chars).alias("short"),
        *[F.count_if(F.col(label) == c).alias(f"c{k}") for k, c in enumerate(shares)],
        F.count_if(~F.col(origin).eqNullSafe(F.lit(constant))).alias("foreign"))
    seen = per_key.agg(
        F.sum("n").alias("rows"), F.count_if((F.col("n") > 1) | F.col(key).isNull()).alias("bad"), F.sum("short").alias("short"),
        *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(shares))], F.sum("foreign").alias("foreign"))

    def check(name: str, observed: Column, expected: int | Column) -> Column:
        wanted = expected if isinstance(expected, Column) else F.lit(expected)
        return F.struct(F.lit(name).alias("check"), observed.cast("long").alias("observed"), wanted.cast("long").alias("expected"),
                        (observed == wanted).alias("ok"))

    checks = [check("rows", F.col("rows"), rows), check("bad_keys", F.col("bad"), 0), check("short_texts", F.col("short"), 0),
              *[check(f"class_{c}", F.col(f"c{k}"), n) for k, (c, n) in enumerate(shares.items())], check("foreign_rows", F.col("foreign"), 0)]
    return seen.select(F.inline(F.array(*checks)))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path; their content is read only where it is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def _open(path: str) -> pa.NativeFile:
    """A file by the path that Spark names it with, which is not escaped."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, _, inside = rest.removeprefix("//").partition("/")
    system, root = pafs.FileSystem.from_uri(f"{_ARROW_SCHEMES.get(scheme, scheme)}://{host}/")
    return system.open_input_file(f"{root.rstrip('/')}/{inside}")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length, start, bytes) to path, length, start and the SHA-256 of these bytes, holding one piece at a time."""
    for batch in batches:
        digests = []
        for path, start, size in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            digest = hashlib.sha256()
            with _open(path) as file:
                file.seek(start)
                while size > 0:
                    piece = file.read(min(size, _PIECE))
                    if not piece:
                        raise OSError(f"{path} became shorter while it was read")
                    digest.update(piece)
                    size -= len(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string())], ["path", "length", "start", "digest"])


def _spread(pieces: DataFrame) -> DataFrame:
    """Every piece is costly for its size as a row, so they are dealt to all cores, whatever file they are of."""
    cores = pieces.sparkSession.sparkContext.defaultParallelism
    dealt = pieces.select("path", "length", "start", "bytes").repartition(4 * cores, "path", "start")
    return dealt.mapInArrow(_streamed, "path string, length long, start long, digest string")


def file_digests(spark: SparkSession, path: str, suffix: str | None = None, whole: int = WHOLE_BYTES) -> DataFrame:
    """SHA-256 per file, of any size but 0; with ``suffix`` the identity of (content, text column)."""
    files = _files(spark, path)
    short = files.filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("digest"))
    long = files.filter(F.col("length") > whole).select("path", "length", F.lit(0).cast("long").alias("start"), F.col("length").alias("bytes"))
    digests = short.unionByName(_spread(long).drop("start"))
    identity = F.concat("digest", F.lit(f":{suffix}")) if suffix else F.col("digest")
    return digests.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", identity.alias("identity"))


def range_digests(spark: SparkSession, path: str, name: Column | None = None, size: int = RANGE_BYTES, whole: int = WHOLE_BYTES) -> DataFrame:
    """(file, length, start, digest): SHA-256 of each range of ``size`` bytes of all files below ``path``.

    ``name`` of ``path`` is what a file is known by in a record, by default its path below the folder; several files of one name
    are an error of the caller. The digests don't depend on how a file was read. Spark's reader passes over empty files, so they
    have no range, and a file that was emptied counts as missing."""
    files = _files(spark, path)
    whole = min(whole, (1 << 31) - 1 - size)
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    hashed = F.transform(starts, lambda at: F.struct(
        at.alias("start"), F.sha2(F.substring(F.col("content"), at.cast("int") + 1, F.lit(size)), 256).alias("digest")))
    short = files.filter(F.col("length") <= whole).select("path", "length", F.inline(hashed))
    pieces = files.filter(F.col("length") > whole).select("path", "length", F.explode(starts).alias("start"))
    found = short.unionByName(_spread(pieces.withColumn("bytes", F.least(F.lit(size).cast("long"), F.col("length") - F.col("start")))))
    below = F.regexp_replace(F.col("path"), "^[a-zA-Z0-9]+:/*(?=/)", "")
    if name is None:
        folder = f"/{path.split(':', 1)[-1].strip('/')}/"
        at = F.locate(folder, below)
        name = F.when(at > 0, F.substring(below, at + len(folder), F.length(below))).otherwise(below)
    return found.select(name.alias("file"), "length", "start", "digest")


def roots(ranges: DataFrame) -> DataFrame:
    """(file, length, root): one digest per file over those of its ranges in order, of which there are length / size."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda r: r["digest"])
    return ranges.groupBy("file").agg(F.max("length").alias("length"), F.sha2(F.array_join(parts, ":"), 256).alias("root"))


def compare_ranges(recorded: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, status, start): recorded against present ranges of the same size.

    A file is unchanged, added or missing as a whole, by its root; of a changed file each range that differs, is new or is gone
    is a row with its first byte."""
    was = roots(recorded).select("file", F.col("root").alias("_was"))
    now = roots(ranges).select("file", F.col("root").alias("_now"))
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "missing").when(F.col("_was") == F.col("_now"), "unchanged")
    judged = was.join(now, "file", "full").select("file", status.otherwise("changed").alias("status"))
    changed = judged.filter("status = 'changed'").select("file")
    old, new = (r.join(changed, "file", "left_semi").select("file", "start", F.col("digest").alias(d)) for r, d in ((recorded, "_was"), (ranges, "_now")))
    differ = old.join(new, ["file", "start"], "full").filter(~F.col("_was").eqNullSafe(F.col("_now")))
    return judged.filter("status <> 'changed'").select("file", "status", F.lit(None).cast("long").alias("start")).unionByName(
        differ.select("file", F.lit("changed").alias("status"), "start"))


def frozen(spark: SparkSession, path: str, recorded: str) -> DataFrame:
    """Does every file still have the recorded digest?"""
    return file_digests(spark, path).withColumn("unchanged", F.col("identity") == recorded)
