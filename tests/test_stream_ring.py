"""Rate look-back with a ring of times per key: exact for ordered batches, bounded state, expiry."""

import random
from datetime import datetime, timedelta

import pytest

from vozlake.streaming import jobs

START = datetime(2024, 1, 1)


def run(spark, folder, batches, **kw):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(u, START + timedelta(seconds=s)) for u, s in rows], "user string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.finish(jobs.append_keyed(jobs.rate_ring(stream, "user", "ts", **kw), f"{folder}/data", f"{folder}/checkpoint"))
    rows = spark.read.parquet(f"{folder}/data").collect()
    return sorted((r.user, (r.ts - START).total_seconds(), (r.until - START).total_seconds()) for r in rows)


def brute(rows, limit=5, span=62):
    out = []
    for user in {u for u, _ in rows if u}:
        times = sorted(s for u, s in rows if u == user)
        out += [(user, t, times[i - limit] + span) for i, t in enumerate(times) if i >= limit and times[i - limit] > t - span]
    return sorted(out)


def test_one_batch(spark, tmp_path):
    times = {"burst": [30, 40, 50, 60, 70, 91], "edge": [0, 1, 2, 3, 4, 62], "inside": [0, 1, 2, 3, 4, 61.5], "same": [500] * 7, "long": [3 * k for k in range(300)]}
    rows = [(u, s) for u, v in times.items() for s in v] + [(None, 1.0)] * 9
    random.Random(1).shuffle(rows)
    found = run(spark, tmp_path, [rows])
    assert found == brute(rows) and {u for u, *_ in found} == {"burst", "inside", "same", "long"}


def test_batches_in_order_keep_what_they_need(spark, tmp_path):
    rnd = random.Random(2)
    batches, at = [], 0.0
    for _ in range(4):
        batch = []
        for _ in range(60):
            at += rnd.choice([0, 0, 1, 5, 40])
            batch.append((rnd.choice("ab"), at))
        rnd.shuffle(batch)
        batches.append(batch)
    assert run(spark, tmp_path, batches, limit=3) == brute([r for b in batches for r in b], 3)


def test_a_quiet_key_is_forgotten(spark, tmp_path):
    batches = [[("a", s) for s in range(5)], [("b", 5000)], [("c", 9000)], [("a", 9001)]]
    assert run(spark, tmp_path, batches) == []
    states = spark.read.format("statestore").option("stateVarName", "times").load(f"{tmp_path}/checkpoint")
    held = {r.key["_key"]: list(r.value["times"]) for r in states.collect()}
    assert "c" in held and len(held.get("a", [])) <= 5
