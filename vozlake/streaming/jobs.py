"""Structured Streaming twins of the journal, rate and scoring jobs.

All run with ``availableNow``: they take what has arrived, commit and stop, so
the same code serves a schedule or, with another trigger, a standing query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vozlake import constants as C
from vozlake.operators import indexed, scoring
from vozlake.operators.scoring import LinearModel
from vozlake.sources import folders


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def read_table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a stored table as they arrive; the table is one file or a folder of files, as for :func:`sources.tables.read_table`."""
    folder, _, name = path.rstrip("/").rpartition("/")
    # a pattern, as the file source takes a plain path for a folder; a character in brackets stands for itself
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append: the file sink commits a batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()


def missing_fields(required: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required]))


def journal(stream: DataFrame, required: Sequence[str]) -> DataFrame:
    """Complete records; :func:`quarantine` takes the others."""
    return stream.filter(F.size(missing_fields(required)) == 0)


def quarantine(stream: DataFrame, required: Sequence[str]) -> DataFrame:
    """Records that :func:`journal` holds back, with the names of their missing fields."""
    return stream.withColumn("missing", F.array_join(missing_fields(required), "|")).filter(F.col("missing") != "")


def _last(records: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Record of the greatest sequence per key; of equal ones the same one each time."""
    rest = [c for c in records.columns if c not in keys]
    order = F.struct(F.col(sequence), F.xxhash64(*rest))
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def latest_state(stream: DataFrame, keys: Sequence[str], sequence: str, path: str, checkpoint: str, every: int = 10,
                 ts: str | None = None, keep: str | None = None) -> StreamingQuery:
    """Last record per key; :func:`read_latest` gives the table.

    A batch writes the last record of its own keys. Every ``every`` batches these and the last snapshot become a new snapshot, and
    what the snapshot before that replaced is removed, so a reader takes one snapshot and fewer than ``2 * every`` batches for ever
    and no state is held between batches. A batch that is repeated after a crash replaces its own folders. With ``ts`` and ``keep``
    (an interval) records older than the newest by ``keep`` expire.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folders.writer(_last(batch, keys, sequence)).parquet(folders.child(path, "batch", number))
        if number % every == every - 1:
            bases = [n for n in _numbers(spark, path, "snapshot") if n < number]
            folders.writer(_merged(spark, path, keys, sequence, number, ts, keep)).parquet(folders.child(path, "snapshot", number))
            for kind, names, last in (("batch", _numbers(spark, path, "batch"), max(bases, default=-1)), ("snapshot", bases, max(bases, default=0) - 1)):
                for n in names:
                    if n <= last:
                        folders.drop(spark, folders.child(path, kind, n))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    return sorted(int(n) for n in folders.complete(spark, path, kind))


def _merged(spark: SparkSession, path: str, keys: Sequence[str], sequence: str, upto: int | None, ts: str | None, keep: str | None) -> DataFrame:
    bases = [n for n in _numbers(spark, path, "snapshot") if upto is None or n < upto]
    base = bases[-1] if bases else -1
    batches = [n for n in _numbers(spark, path, "batch") if n > base and (upto is None or n <= upto)]
    found = [folders.child(path, "batch", n) for n in batches] + ([folders.child(path, "snapshot", base)] if bases else [])
    if not found:
        raise ValueError(f"no complete batch below {path}")
    last = _last(spark.read.parquet(*found), keys, sequence)
    if ts is None or keep is None:
        return last
    newest = last.agg(F.max(ts).alias("_newest"))
    return last.withColumn("_newest", newest.scalar()).filter(F.col(ts) > F.col("_newest") - F.expr(f"INTERVAL {keep}")).drop("_newest")


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], sequence: str, ts: str | None = None, keep: str | None = None) -> DataFrame:
    """The table of :func:`latest_state`: the same for any order and repetition of batches.

    With an expiry this holds where ``ts`` does not fall while a key's sequence grows.
    """
    return _merged(spark, path, keys, sequence, None, ts, keep)


def rate_alerts(stream: DataFrame, key: str, ts: str, limit: int = C.PACING_REQUESTS,
                window: str = "62 seconds", slide: str = "31 seconds", delay: str = "10 minutes") -> DataFrame:
    """Windows in which a provider exceeds ``limit`` requests; late rows drop past the watermark."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, window, slide), key).agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > limit)
        .select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests"))


def rate_lookback(stream: DataFrame, key: str, ts: str, limit: int = C.PACING_REQUESTS,
                  seconds: float = C.PACING_WINDOW_SECONDS + C.PACING_MARGIN_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Requests that come when ``limit`` or more others of their key are less than ``seconds`` old; of equal times one comes first.

    ``requests`` counts those and the request itself. A window is two look-backs long and judges the requests of its second half,
    so each request has its whole look-back in one window and is judged once; late rows drop past the watermark.
    """
    span = round(seconds * 1_000_000)
    times = F.array_sort(F.collect_list(F.unix_micros(ts)))
    found = stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{2 * span} microseconds", f"{span} microseconds"), key).agg(times.alias("_times"))

    def judged(at: Column, i: Column) -> Column:
        # binary search for the number of times that have expired
        def halve(x: Column, _: Column) -> Column:
            middle = F.floor((x["low"] + x["high"]) / 2).cast("int")
            gone, open_ = F.get(F.col("_times"), middle) <= at - span, x["low"] < x["high"]
            return F.struct(F.when(open_ & gone, middle + 1).otherwise(x["low"]).alias("low"),
                            F.when(open_ & ~gone, middle).otherwise(x["high"]).alias("high"))

        expired = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(i))), F.struct(F.lit(0).alias("low"), i.alias("high")), halve)["low"]
        return F.struct(F.timestamp_micros(at).alias(ts), (i + 1 - expired).cast("long").alias("requests"))

    counted = F.filter(F.transform("_times", judged), lambda x: (x["requests"] > limit) & (F.unix_micros(x[ts]) >= F.unix_micros("window.start") + span))
    return found.select(key, F.inline(counted))


class _Ring(StatefulProcessor):
    """Per key the last ``limit`` request times; a timer forgets a key that has been quiet for a whole look-back."""

    def __init__(self, limit: int, span: int) -> None:
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("times", "times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = np.array(self.state.get()[0] if self.state.exists() else [], dtype=np.int64)
        # the second column; derived ones come without their names
        come = np.concatenate([p.iloc[:, 1].to_numpy(dtype=np.int64) for p in rows])
        times = np.concatenate([held, come])
        order = np.argsort(times, kind="stable")
        times, new = times[order], order >= len(held)
        before = np.full(len(times), np.iinfo(np.int64).min)
        before[self.limit:] = times[:-self.limit]
        over = new & (before > times - self.span)
        if over.any():
            yield pd.DataFrame({"key": [key[0]] * int(over.sum()), "at": times[over], "until": before[over] + self.span})
        self.state.update((times[-self.limit:].tolist(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(times[-1] + self.span) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_ring(stream: DataFrame, key: str, ts: str, limit: int = C.PACING_REQUESTS,
              seconds: float = C.PACING_WINDOW_SECONDS + C.PACING_MARGIN_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Requests that come when ``limit`` others of their key are less than ``seconds`` old, and when the first of these expires.

    Requests are judged as they arrive, each micro-batch in order of time, also those after the last watermark. The state of a key is
    ``limit`` times at any rate. A request that arrives after a later one of an earlier micro-batch is judged by the times still held;
    beyond the watermark it is dropped. A task holds eight bytes for each request of a key in one micro-batch.
    """
    span = round(seconds * 1_000_000)
    timed = stream.filter(F.col(key).isNotNull()).withWatermark(ts, delay).select(F.col(key).alias("_key"), F.unix_micros(ts).alias("_us"), ts)
    kind = stream.schema[key].dataType.simpleString()
    found = timed.groupBy("_key").transformWithStateInPandas(
        _Ring(limit, span), f"key {kind}, at long, until long", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.timestamp_micros("until").alias("until"))


_STORE = "spark.sql.streaming.stateStore.providerClass"


def append_keyed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """:func:`append` for jobs with keyed state, which need the RocksDB store; a query keeps the settings it was started with."""
    conf = stream.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return append(stream, path, checkpoint)
    finally:
        conf.set(_STORE, before)


def score_stream(stream: DataFrame, model: LinearModel | None = None, text_col: str = "text") -> DataFrame:
    """Stateless scoring with the very same code as the batch job."""
    return scoring.score(scoring.prepare(stream, text_col), model, text_col)


def publish_model(table: DataFrame, models: str, version: int) -> None:
    """Store a coefficient table under a new version; a version is never replaced once complete."""
    folder = folders.child(models, "version", version)
    if folders.is_complete(table.sparkSession, folder):
        raise ValueError(f"version {version} is published")
    folders.writer(table).parquet(folder)


def score_versions(stream: DataFrame, models: str, path: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Standing scoring with a model that changes: each micro-batch by the newest version when it starts.

    The version of a batch is stored before it is scored, so a batch that is repeated after a crash gets the same model, whatever
    has been published since. :func:`read_scored` gives the rows with their ``model_version``.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        choice = folders.child(path, "choice", number)
        if not folders.is_complete(spark, choice):
            published = _numbers(spark, models, "version")
            if not published:
                raise ValueError(f"no model below {models}")
            folders.writer(spark.createDataFrame([(published[-1],)], "version long")).parquet(choice)
        version = spark.read.parquet(choice).first()[0]
        table = spark.read.parquet(folders.child(models, "version", version))
        scored = indexed.score(scoring.prepare(batch, text_col), table, text_col)
        folders.writer(scored.withColumn("model_version", F.lit(version).cast("long"))).parquet(folders.child(path, "scored", number))

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    found = [folders.child(path, "scored", n) for n in _numbers(spark, path, "scored")]
    if not found:
        raise ValueError(f"no complete batch below {path}")
    return spark.read.parquet(*found)


def on_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, condition: Column | None = None) -> StreamingQuery:
    """Hand arriving rows to a batch job, for example a hybrid review with its own budget."""
    rows = stream if condition is None else stream.filter(condition)
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
