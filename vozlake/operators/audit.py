"""Corpus audits: distributions, duplicates, conflicts, splits, leakage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vozlake.durable import cut
from vozlake.functions import text as tx
from vozlake.operators import joins, ranking


def distributions(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by each column, by both and overall, from one aggregation."""
    counted = df.groupingSets([[F.col(first)], [F.col(second)], [F.col(first), F.col(second)], []], F.col(first), F.col(second)) \
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level"))
    names = F.when(F.col("_level") == 0, f"{first}+{second}").when(F.col("_level") == 1, first).when(F.col("_level") == 2, second).otherwise("rows")
    return counted.select(names.alias("distribution"), first, second, "n")


def duplicates(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows beyond the first of each distinct value, per named column.

    Texts are compared by digest, so a shuffled row is 32 bytes whatever the
    comment length, and copies collapse before the shuffle.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.unhex(F.sha2(col, 256)).alias("digest")) for name, col in columns.items()])))
    groups = long.groupBy("check", "digest").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("check").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_values"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def label_conflicts(df: DataFrame, value: Column, label: str) -> DataFrame:
    """Digests of values that carry more than one label."""
    pairs = df.select(F.md5(value).alias("digest"), F.col(label)).groupBy("digest", label).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).filter("labels > 1")


def stratified_split(df: DataFrame, key: str, strata: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact per-class hash split: the ceil(share * n) smallest digests are test.

    Keys are counted by class and the first four hex digits of their digest, which
    finds the bucket the cut falls in; one key in 65 536 is ranked, and a row is
    compared with its class's last test digest, so no other column is shuffled.
    A null class is a class. Rows of one key, and those without a key, share a side.
    """
    digest = F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), F.lit(f"{seed}")))
    narrow = df.select(strata, digest.alias("_digest")).withColumn("_bucket", F.substring("_digest", 1, 4))
    counts = narrow.groupBy(strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most 65 536 rows per class
    upto = Window.partitionBy(strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(strata)))
    want = F.ceil(F.col("_all") * F.lit(int(round(test_share * 100))) / 100)
    room = want - (F.col("_upto") - F.col("_n"))
    edge = cut(sized.select(strata, "_bucket", room.alias("_room"), "_n").filter("_room between 1 and _n"), "split-edge")
    turn = Window.partitionBy(strata).orderBy("_digest")
    placed = ranking.join_groups(narrow, edge, [strata, "_bucket"]).withColumn("_turn", F.row_number().over(turn))
    last = cut(placed.filter(F.col("_turn") == F.col("_room")).select(strata, F.col("_digest").alias("_last")), "split-last")
    side = F.when(digest <= F.col("_last"), "test").otherwise("train")
    return ranking.join_groups(df, last, [strata], "left").withColumn("split", side).drop("_last")


def leakage(df: DataFrame, key: str, split: str = "split", text_col: str = "text") -> DataFrame:
    """Test rows that share a cleaned sentence with train, and their share."""
    parts = F.transform(tx.sentence_parts(F.col(text_col)), lambda p: F.unhex(F.md5(p)))
    test, train = df.filter(F.col(split) == "test"), df.filter(F.col(split) == "train")
    shared = joins.sharing_rows(test, train, key, parts).agg(F.count(F.lit(1)).alias("sharing_rows"))
    total = test.agg(F.count(F.lit(1)).alias("test_rows"))
    return total.withColumn("sharing_rows", shared.scalar()).withColumn(
        "share_percentage", F.round(F.col("sharing_rows") * 100.0 / F.nullif("test_rows", F.lit(0)), 6))


def table_digest(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of rows: count plus the sums of two 64-bit parts of row digests.

    A sum keeps repeated rows visible, which an exclusive-or would cancel out. Each
    value goes with its length and a null has a mark of its own, so no two rows read alike.
    """
    marked = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    hashed = df.select(*group_cols, F.sha2(F.concat(*marked), 256).alias("_sha"))
    parts = [F.sum(F.conv(F.substring("_sha", k, 16), 16, 10).cast("decimal(20,0)")).cast("string") for k in (1, 17)]
    return hashed.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *parts).alias("digest"))


def compare_digests(recorded: DataFrame, current: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Batches of two :func:`table_digest` tables: unchanged, changed, added or missing, with the row count of each."""
    was = recorded.select(*[F.col(c).alias(f"_w_{c}") for c in group_cols], F.col("rows").alias("recorded_rows"), F.col("digest").alias("_was"))
    meet = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in group_cols], F.lit(True))
    status = (
        F.when(F.col("_was").isNull(), "added").when(F.col("digest").isNull(), "missing")
        .when((F.col("recorded_rows") == F.col("rows")) & (F.col("_was") == F.col("digest")), "unchanged").otherwise("changed"))
    return current.join(was, meet, "full").select(
        *[F.coalesce(c, f"_w_{c}").alias(c) for c in group_cols], "recorded_rows", "rows", status.alias("status"))
