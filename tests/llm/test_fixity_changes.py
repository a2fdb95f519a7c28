"""Audit of replicas in which records changed their length, went, came or moved, against a flat comparison of all records."""

import random
from collections import Counter

from pyspark.sql import functions as F

from vozlake.durable import scratch
from vozlake.llm import fixity


def flat(ours, theirs):
    """Differences as counted rows (archive, status, record_id, expected, found), moved records aside."""
    out, moved = Counter(), 0
    for archive in {r[0] for r in ours + theirs}:
        a, b = ([r[1:] for r in side if r[0] == archive] for side in (ours, theirs))
        at_both = Counter(a) & Counter(b)
        a, b = list((Counter(a) - at_both).elements()), list((Counter(b) - at_both).elements())
        na, nb = (Counter(r[1:] for r in side) for side in (a, b))
        same = {k for k in na if na[k] == nb[k]}
        moved += sum(na[k] for k in same)
        a, b = ([r for r in side if r[1:] not in same] for side in (a, b))
        for place in (2, 0):
            ka, kb = (Counter(r[place] for r in side) for side in (a, b))
            lone = {k for k in ka if k != "" and ka[k] == kb[k] == 1}
            for k in lone:
                x, y = (next(r for r in side if r[place] == k) for side in (a, b))
                out[archive, "corrupt", x[2], x[3], y[3]] += 1
            a, b = ([r for r in side if r[place] not in lone] for side in (a, b))
        out.update((archive, "missing", r[2], r[3], None) for r in a)
        out.update((archive, "extra", r[2], None, r[3]) for r in b)
    return out, moved


def seen(rows):
    out, moved = Counter(), 0
    for r in rows:
        if r.status == "moved":
            assert r.offset != r.found_offset
            moved += r.records
        else:
            out[r.archive, r.status, r.record_id, r.expected_sha256, r.found_sha256] += r.records
    return out, moved


def laid_out(rnd, records):
    """Records (archive, id, length, hash) with the offsets at which they would stand."""
    at, out = Counter(), []
    for archive, name, length, digest in records:
        out.append((archive, at[archive], length, name, digest))
        at[archive] += length
    return out


def test_random_changes(spark):
    rnd = random.Random(3)
    records = [(f"a{i % 4}", rnd.choice([f"<{i}>", f"<{i}>", "", "<same>"]), rnd.choice([10, 700, 70_000]), f"h{rnd.randrange(120)}") for i in range(400)]
    changed = []
    for archive, name, length, digest in records:
        kind = rnd.random() if archive != "a0" else 1
        if kind < 0.02:
            continue
        if kind < 0.04:
            digest += "x"
        elif kind < 0.06:
            length, digest = length + 1, digest + "y"
        elif kind < 0.07:
            name = name + "?"
        elif kind < 0.09:
            changed.append((archive, "<new>", 33, "n"))
        changed.append((archive, name, length, digest))
    ours, theirs = laid_out(rnd, records), laid_out(rnd, changed)
    sides = [spark.createDataFrame(s, fixity.RECORD_SCHEMA) for s in (ours, theirs)]
    got, want = seen(fixity.audit(*sides).collect()), flat(ours, theirs)
    assert got == want and got[1] > 50 and {s for _, s, *_ in got[0]} == {"corrupt", "missing", "extra"}


def test_one_byte_more(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"),
                                    F.repeat(F.lit("body "), (F.col("id") % 50).cast("int")).alias("html")).coalesce(1)
    longer = pages.withColumn("html", F.when(F.col("page_id") == 3, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    a, b = (fixity.read_records(spark, fixity.write_warc(p, scratch(spark, "warc"))) for p in (pages, longer))
    out = {r.status: r for r in fixity.audit(a, b).collect()}
    # two digits of the length would move the rest by another distance; here all by one byte
    assert set(out) == {"corrupt", "moved"} and out["corrupt"].record_id == "<urn:record:3>"
    assert out["moved"].records == 296 and out["moved"].found_offset - out["moved"].offset == 1


def test_hot_offset(spark):
    """Many records at one place are listed, not paired with each other."""
    a = spark.range(500).select(F.lit("a").alias("archive"), F.lit(None).cast("long").alias("offset"), F.lit(5).cast("long").alias("length"),
                                F.lit("").alias("record_id"), F.concat(F.lit("x"), "id").alias("sha256"))
    b = a.withColumn("sha256", F.concat(F.lit("y"), "sha256"))
    assert {r.status: r["count"] for r in fixity.audit(a, b).groupBy("status").count().collect()} == {"missing": 500, "extra": 500}
