"""Selection of exact quantiles against sorted lists, with splits forced by small bounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vozlake.operators import quantiles


def brute(values, percent):
    values = sorted(values)
    at, rest = divmod(percent * (len(values) - 1), 100)
    upper = values[min(at + 1, len(values) - 1)]
    return values[at] + (upper - values[at]) * (rest / 100), values[at]


def sample(kind):
    rnd = random.Random(kind)
    return {
        "uniform": lambda: [rnd.random() for _ in range(900)],
        "ties": lambda: [rnd.choice([0.1, 0.2, 0.3]) for _ in range(700)],
        "wide": lambda: [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) * rnd.random() for _ in range(800)],
        "narrow": lambda: [1.0 + k * 2.0**-52 for k in range(500)],
        "infinite": lambda: [math.inf, -math.inf] + [float(k) for k in range(60)],
        "one": lambda: [4.5],
        "equal": lambda: [2.0] * 300,
    }[kind]()


KINDS = ("uniform", "ties", "wide", "narrow", "infinite", "one", "equal")


@pytest.mark.parametrize("held,pieces", [(65_536, 256), (40, 8), (1, 2)])
def test_groups(spark, held, pieces):
    data = {k: sample(k) for k in (KINDS if held > 1 else ("infinite", "one", "equal", "ties"))}
    rows = [(k, v) for k, values in data.items() for v in values] + [(None, 1.0), (None, 3.0), ("nothing", None)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    found = quantiles.exact_quantiles(df, ["g"], F.col("v"), {"p25": 25, "p50": 50, "p95": 95}, {"low": 95}, held=held, pieces=pieces)
    got = {r.g: (r.n, r.minimum, r.maximum, r.p25, r.p50, r.p95, r.low) for r in found.collect()}
    data[None] = [1.0, 3.0]
    assert got == {k: (len(v), min(v), max(v), brute(v, 25)[0], brute(v, 50)[0], brute(v, 95)[0], brute(v, 95)[1]) for k, v in data.items()}


def test_weights_whole_numbers_and_no_groups(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(-10**15, 10**15), rnd.randint(0, 4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "v long, w long")
    row = quantiles.exact_quantiles(df, [], F.col("v"), {"m": 50}, {"l": 10}, weight=F.col("w"), held=16, pieces=4).first()
    flat = [v for v, w in rows for _ in range(w)]
    assert (row.n, row.m, row.l) == (len(flat), brute(flat, 50)[0], brute(flat, 10)[1])


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantiles(df, ["g"], F.col("v"), {"m": 50}).collect() == []
