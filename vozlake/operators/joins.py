"""Key-checked joins and the guard that keeps references away from the scorer."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C


def leak_guard(df: DataFrame, key: str, text_col: str,
               forbidden: Iterable[str] = C.PROHIBITED_COLUMNS) -> DataFrame:
    """Only the key and the text may reach the scorer."""
    kept = df.select(key, text_col)
    leaked = sorted({c.strip().lower() for c in kept.columns} & set(forbidden))
    if leaked:
        raise ValueError(f"prediction or reference columns cannot be model input: {leaked}")
    return kept


def selectable_columns(columns: Iterable[str],
                       reserved: Iterable[str] = ("expected_sentiment", "sentiment_expected", "label")) -> list[str]:
    """Columns a user may pick as comment text: reserved targets are hidden."""
    hidden = {r.casefold() for r in reserved}
    return [c for c in columns if str(c).strip().casefold() not in hidden]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``; a repeated key on either side fails the job.

    The repetition test rides on the join shuffle: both sides are counted by the
    join key, so no extra exchange is needed for it.
    """
    def checked(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        packed = df.groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_row")
        )
        guarded = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{side} key repeats: "), F.col(key).cast("string"))))
        return packed.select(key, F.coalesce(guarded.cast("string"), F.lit("")).alias(f"_ok_{side}"), "_row.*")

    joined = checked(left, "left").join(checked(right, "right"), key)
    return joined.filter((F.col("_ok_left") == "") & (F.col("_ok_right") == "")).drop("_ok_left", "_ok_right")


#: keys that may be broadcast (some tens of megabytes)
MAX_KEYS = 1_000_000


def only_keys(df: DataFrame, references: DataFrame, key: str, limit: int = MAX_KEYS) -> DataFrame:
    """The rows whose key has a reference, so that costly work on a row is done for these only.

    The keys are counted first. Beyond ``limit`` all rows stay, as the text would have to move to meet the keys; the join with the
    references that follows gives the same answer then."""
    keys = references.select(key).filter(F.col(key).isNotNull()).distinct()
    if keys.count() > limit:
        return df
    return df.join(F.broadcast(keys), key, "left_semi")


def compare_packets(first: DataFrame, second: DataFrame, key: str = "case_id",
                    fields: Sequence[str] = C.PACKET_SHARED_FIELDS) -> DataFrame:
    """Cases missing from B, added in B, or whose shared fields differ."""
    a = first.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = second.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields
    ]))
    verdict = (
        F.when(F.col("_b").isNull(), "missing_from_b")
        .when(F.col("_a").isNull(), "additional_in_b")
        .when(F.size(differing) > 0, "fields_differ")
    )
    return both.select(
        key, verdict.alias("problem"),
        F.when(verdict == "fields_differ", F.array_join(differing, "|")).alias("fields"),
    ).filter(F.col("problem").isNotNull())


def ids_in_both(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """Label pairs of the cases that both annotators completed."""
    def done(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.coalesce(F.col(label), F.lit("")) != "").select(key, F.col(label).alias(name))

    return done(first, "label_a").join(done(second, "label_b"), key)


def sharing_rows(test: DataFrame, train: DataFrame, key: str, parts: Column) -> DataFrame:
    """Keys of ``test`` rows that share at least one part with ``train``."""
    seen = train.select(F.explode_outer(parts).alias("part")).filter("part is not null").distinct()
    own = test.select(key, F.explode_outer(parts).alias("part")).filter("part is not null")
    return own.join(seen, "part", "left_semi").select(key).distinct()
