"""Topic selection from bounded leading terms against the sequential rule."""

import random

from vozlake.operators import topics


def brute(counts, k):
    order = sorted(counts, key=lambda r: (-r[1], -r[2], r[0]))
    cover = {(w, f) for t, f, n in counts if n == 2 for w in t.split(" ")}
    return [t for t, f, n in order if n == 2 or (t, f) not in cover][:k]


def test_leading_terms_decide(spark):
    rnd = random.Random(11)
    rows, expected = [], {}
    for g in range(30):
        words = [f"w{k}" for k in range(rnd.choice([3, 8, 40]))]
        counts = {}
        for _ in range(rnd.choice([0, 2, 6, 60])):
            a, b = rnd.choice(words), rnd.choice(words)
            counts[f"{a} {b}"] = rnd.randint(1, rnd.choice([2, 9]))
        for w in words:
            touching = [f for t, f in counts.items() if w in t.split(" ")]
            counts[w] = max(touching, default=1) + rnd.choice([0, 0, 0, 1, 3])
        found = [(t, f, 2 if " " in t else 1) for t, f in counts.items()]
        rows += [(str(g), *r) for r in found]
        expected[str(g)] = brute(found, 4)
    df = spark.createDataFrame(rows, "g string, topic string, frequency long, n_words int")
    got = {}
    for r in topics.select_topics(df, ["g"], 4).orderBy("g", "rank").collect():
        got.setdefault(r.g, []).append(r.topic)
    assert got == expected
    one = df.filter("g = '3'").drop("g")
    assert [r.topic for r in topics.select_topics(one, (), 4).orderBy("rank").collect()] == expected["3"]


def test_counts_stay_where_they_are(spark, tmp_path):
    spark.range(1000).selectExpr("concat('s', id % 7) source", "concat('t', id) topic", "id % 50 frequency", "cast(1 + id % 2 as int) n_words").write.parquet(f"{tmp_path}/counts")
    plan = topics.select_topics(spark.read.parquet(f"{tmp_path}/counts"), ["source"])._jdf.queryExecution().executedPlan().toString()
    # what crosses the network by batch has been cut to the leading terms of each partition
    assert "Join" not in plan and plan.count("row_number(), 45, Partial") == 1 and plan.count("row_number(), 15, Partial") == 1
