"""Look-back of the rate alerts over arriving requests."""

from datetime import datetime, timedelta

from vozlake.streaming import jobs

START = datetime(2024, 1, 1)


def alerts(spark, folder, rows, batches=1, **kw):
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size:(k + 1) * size], "user string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.finish(jobs.append(jobs.rate_lookback(stream, "user", "ts", **kw), f"{folder}/data", f"{folder}/checkpoint"))
    return sorted((r.user, (r.ts - START).total_seconds(), r.requests) for r in spark.read.parquet(f"{folder}/data").collect() if r.user != "last")


def at(user, *seconds):
    return [(user, START + timedelta(seconds=s)) for s in seconds]


#: moves the watermark past all others
LAST = at("last", 100_000, 200_000)


def test_burst_across_strides(spark, tmp_path):
    # 00:25 and 01:05 share no window of an hour that starts at a half hour
    rows = at("a", 25 * 60, 65 * 60) + at("b", 0, 3600) + LAST
    assert alerts(spark, tmp_path, rows, limit=1, seconds=3600) == [("a", 65 * 60, 2)]


def test_defaults_look_back_from_each_request(spark, tmp_path):
    times = {"burst": [30, 40, 50, 60, 70, 91], "edge": [0, 1, 2, 3, 4, 62], "inside": [0, 1, 2, 3, 4, 61.5], "same": [500] * 7,
             "long": [3 * k for k in range(200)]}
    rows = [x for user, s in times.items() for x in at(user, *s)] + LAST

    def brute(s):
        s = sorted(s)
        counts = [(t, sum(1 for u in s[:i + 1] if u > t - 62)) for i, t in enumerate(s)]
        return [c for c in counts if c[1] > 5]

    expected = sorted((user, t, n) for user, s in times.items() for t, n in brute(s))
    assert alerts(spark, tmp_path, rows, batches=3) == expected
    assert {u for u, _, _ in expected} == {"burst", "inside", "same", "long"}
