"""Rolling-window pacing of an external call log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vozlake import constants as C
from vozlake.operators import ranking

MICROS = 1_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp, with or without a zone (jobs run in UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def window_micros(window_seconds: float, margin_seconds: float, requests: int = 1) -> int:
    if requests < 1 or window_seconds <= 0 or margin_seconds < 0:
        raise ValueError("pacing needs at least one request, a window above 0 and a margin of 0 or more")
    return round((window_seconds + margin_seconds) * MICROS)


def schedule(log: DataFrame, group_cols: Sequence[str], ts: str, key: str, requests: int = C.PACING_REQUESTS,
             window_seconds: float = C.PACING_WINDOW_SECONDS, margin_seconds: float = C.PACING_MARGIN_SECONDS,
             partitions: int | None = None) -> DataFrame:
    """When each request may start if at most ``requests`` start per rolling window.

    Request i starts at max(arrival, start of request i - N plus the window). On
    every residue of i modulo N that is a running maximum of
    ``arrival - window * (i div N)``, so no request waits on a sequential loop and
    a provider of any size is scanned over many partitions.
    """
    width = window_micros(window_seconds, margin_seconds, requests)
    arrivals = log.withColumn("_at", micros(ts))
    order = [F.col("_at").asc(), F.col(key).asc()]
    placed = ranking.place(arrivals, group_cols, order, partitions)
    counted = ranking.scan(placed, group_cols, order, sums={"_i": F.lit(1).cast("long")}, keep_part=True)
    counted = counted.withColumn("_i", F.col("_i") - 1)
    turn = F.floor(F.col("_i") / requests)
    lanes = counted.withColumn("_lane", F.col("_i") % requests).withColumn("_turn", turn)
    eased = ranking.scan(lanes, [*group_cols, "_lane"], [F.col("_i").asc()],
                         maxima={"_peak": F.col("_at") - F.col("_turn") * width})
    start = F.col("_peak") + F.col("_turn") * width
    return eased.select(
        *log.columns, F.col("_i").alias("position"), F.timestamp_micros(start).alias("scheduled_at"),
        ((start - F.col("_at")) / float(MICROS)).alias("wait_seconds"))


def requests_in_window(log: DataFrame, group_cols: Sequence[str], ts: str,
                       window_seconds: float = C.PACING_WINDOW_SECONDS, margin_seconds: float = C.PACING_MARGIN_SECONDS) -> DataFrame:
    """Earlier requests still inside the rolling window before each request.

    Rows are copied to their own time bucket and the next one, so a window task
    holds two window-lengths of one provider, never its whole history.
    """
    width = window_micros(window_seconds, margin_seconds)
    at = micros(ts)
    home = F.floor(at / width)
    seen = log.select("*", at.alias("_at"), home.alias("_home"), F.explode(F.array(home, home + 1)).alias("_bucket"))
    recent = Window.partitionBy(*group_cols, "_bucket").orderBy("_at").rangeBetween(-(width - 1), Window.currentRow)
    counted = seen.withColumn("requests_in_window_before", F.count(F.lit(1)).over(recent) - 1)
    return counted.filter(F.col("_bucket") == F.col("_home")).select(*log.columns, "requests_in_window_before")


def cooldown(log: DataFrame, group_cols: Sequence[str], completed: str, now: Column,
             clean_seconds: float = C.CLEAN_WINDOW_SECONDS) -> DataFrame:
    """Seconds left until a provider's window is clean."""
    last = micros(F.max(completed))
    left = F.lit(clean_seconds) - (micros(now) - last) / float(MICROS)
    return log.groupBy(*group_cols).agg(F.round(F.greatest(F.lit(0.0), left), 6).alias("cooldown_seconds"))
