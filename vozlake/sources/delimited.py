"""Reading comment tables from delimited text of unknown layout."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F

DELIMITERS = (",", ";", "\t")
CORRUPT = "_corrupt_record"


class TableFormatError(ValueError):
    """The files cannot be read as one comment table."""


@dataclass(frozen=True)
class Layout:
    files: Mapping[str, list[str]]  # by encoding
    delimiter: str | None  # None: every line is one value
    columns: tuple[str, ...]


def clean_names(names: list[str]) -> list[str]:
    """Stripped header names; a blank one is numbered by position."""
    return [n.strip().lstrip("﻿").strip() or f"column_{i}" for i, n in enumerate(names, start=1)]


def encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by encoding: UTF-8 unless some line of the file does not decode. One scan; only file names reach the driver."""
    name = F.col("_metadata.file_path")
    files = spark.read.text(path).groupBy(name.alias("file")).agg(F.bool_and(F.is_valid_utf8("value")).alias("sound")).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(files):
        found.setdefault("UTF-8" if row.sound else "ISO-8859-1", []).append(unquote(row.file))
    # of one encoding the folder is read as it is, with its partition columns
    return {encoding: [path] for encoding in found} if len(found) == 1 else found


def _lines(spark: SparkSession, files: Mapping[str, list[str]]) -> DataFrame:
    """Decoded lines of all files; the text reader hands over bytes as they are."""
    parts = []
    for encoding, names in files.items():
        lines = spark.read.text(names)
        parts.append(lines if encoding == "UTF-8" else lines.select(F.decode(F.col("value").cast("binary"), encoding).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _fields(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter, strict=True))


def sniff(spark: SparkSession, path: str) -> Layout:
    """Layout from the first lines and one pass over the bytes for the encoding of each file."""
    files = encodings(spark, path)
    if not files:
        raise TableFormatError("the file is empty")
    lines = [r.value for r in _lines(spark, files).filter(F.length(F.trim("value")) > 0).limit(2).collect()]
    if not lines:
        raise TableFormatError("the file is empty")
    if len(lines) < 2:
        raise TableFormatError("the file has no data rows")
    header = lines[0].lstrip("﻿")
    try:
        widths = {d: len(_fields(header, d)) for d in DELIMITERS}
    except csv.Error as error:
        raise TableFormatError("the header does not parse") from error
    delimiter, width = max(widths.items(), key=lambda item: item[1])
    if width > 1:
        return Layout(files, delimiter, tuple(clean_names(_fields(header, delimiter))))
    return Layout(files, None, tuple(clean_names(_fields(header, ","))))


def control_characters(spark: SparkSession, layout: Layout) -> int:
    """1 if some line holds a control character other than a tab, else 0."""
    return _lines(spark, layout.files).filter(F.col("value").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).limit(1).count()


def strictly_quoted(line: Column) -> Column:
    """Does the line parse for every delimiter: is each field that opens with a quote closed, with nothing behind the quote?"""
    def parses(d: str) -> Column:
        field = f'(?:"(?:[^"]++|"")*+"|[^"{d}][^{d}]*+)?+'
        return line.rlike(f"(?s)^{field}(?:{d}{field})*+$")

    return reduce(lambda a, b: a & b, [parses(d) for d in DELIMITERS])


def _each(spark: SparkSession, layout: Layout, read: Callable[[DataFrameReader, list[str]], DataFrame]) -> DataFrame:
    parts = [read(spark.read.option("header", True).option("encoding", encoding), names) for encoding, names in layout.files.items()]
    return reduce(DataFrame.unionByName, parts)


def read_delimited(spark: SparkSession, path: str, layout: Layout | None = None, multi_line: bool = False,
                   max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined lines). All columns are text; rows that do not fit are set aside.

    Each file is read in its own encoding; a folder that mixes them is read by file name, without partition columns. Where a line is one value, a quote that is not closed, or has text behind it, sets the
    line aside for any of the delimiters; a value that is quoted as a whole loses its quotes.
    ``multi_line`` allows line breaks inside quotes, but then a file is one task.
    ``max_rows`` is an optional guard that fails instead of cutting the table.
    """
    layout = layout or sniff(spark, path)
    if layout.delimiter is None:
        if control_characters(spark, layout):
            raise TableFormatError("a single-column file cannot hold control characters")
        # a separator that text cannot hold, and no quoting: the whole line is the value
        only = F.col(f"`{layout.columns[0]}`")
        lines = _each(spark, layout, lambda reader, names: reader.option("sep", "\x1f").option("quote", "").schema(
            f"`{layout.columns[0]}` string").csv(names)).filter(only.isNotNull())
        whole = F.regexp_extract(only, r'(?s)^"(.*)"$', 1)
        rows = lines.filter(strictly_quoted(only)).withColumn(
            layout.columns[0], F.when(only.startswith('"'), F.replace(whole, F.lit('""'), F.lit('"'))).otherwise(only))
        quarantined = lines.filter(~strictly_quoted(only)).toDF("line")
    else:
        fields = ", ".join(f"`{c}` string" for c in (*layout.columns, CORRUPT))
        # every field is parsed even when few are asked for: a row with a surplus field
        # would otherwise look sound to a query that reads one column
        options = {"columnPruning": False, "sep": layout.delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
                   "quote": '"', "escape": '"', "multiLine": multi_line, "enforceSchema": True}
        parsed = _each(spark, layout, lambda reader, names: reader.options(**options).schema(fields).csv(names))
        # a bare null test on this column would be pushed into the parser, which runs it
        # before the column is filled; naming a second column keeps a bare count legal,
        # which may not read this one alone
        first = F.col(f"`{layout.columns[0]}`")
        broken = F.length(F.concat_ws("", F.col(CORRUPT), first)) > F.length(F.coalesce(first, F.lit("")))
        rows = parsed.filter(~broken).drop(CORRUPT)
        quarantined = parsed.filter(broken).select(F.col(CORRUPT).alias("line"))
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise TableFormatError(f"the file has more than {max_rows:,} rows")
    return rows, quarantined


def write_delimited(df: DataFrame, path: str, partition_by: list[str] | None = None, delimiter: str = ",") -> None:
    """CSV with header, columns in order, one folder per batch when asked.

    Quotes are doubled, and line breaks stay inside quotes: read such text back
    with ``multi_line=True``.
    """
    writer = df.write.option("header", True).option("sep", delimiter).option("escape", '"').option("quote", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
