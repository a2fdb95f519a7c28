"""Ranked search against brute force, and the bounds of term pairs."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from vozlake.llm import lexical
from vozlake.llm.queries import ORACLES, QUERIES

TERMS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k=10):
    held = [(key, collections.Counter(terms(t))) for key, t in docs]
    held = [(key, c) for key, c in held if c]
    total, words = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scores = []
        for key, c in held:
            m = 10 + 90 * sum(c.values()) * total // words
            scores.append((-sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                                for t in set(terms(text)) if t in c), key is None, key or 0, key))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1) if s[0] < 0]
    return sorted(map(str, out))


SCHEMA = "doc_id long, text string, shard string, term string, ids long"


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(11)
    vocabulary = [f"t{i}" for i in range(300)] + ["é", "Ñu", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 5, 40, 300])))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(15)] + [(None, docs[7][1]), (None, None), (500, None), (501, ""), (502, "--- ."), (9, docs[9][1])]
    queries = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 9, 30])))) for i in range(25)]
    queries += [(100, docs[7][1]), (101, None), (102, "nowhere at-all"), (None, "T1, t2"), (100, "t1"), (103, "t0 t0 t0")]
    return docs, queries


@pytest.mark.parametrize("shard,block", [(16 << 20, 1 << 20), (3000, 400)])
def test_search(spark, table, shard, block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical.ts, "CHUNK_BYTES", 900)
    docs, queries = table
    frame = spark.createDataFrame([(*d, "clash", "clash", 1) for d in docs], SCHEMA).repartition(3)
    items = spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, query string")
    index = lexical.build(frame, shard_bytes=shard)
    assert sorted(str(tuple(r)) for r in lexical.search(index, items).collect()) == brute(docs, queries)


def test_empty_tables(spark, table):
    docs, queries = table
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(queries, "item_id long, text string")
    assert lexical.search(lexical.build(none), items).count() == 0
    found = lexical.search(lexical.build(spark.createDataFrame(docs, "doc_id long, text string")), items.filter("false"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_pair_bounds_skip_more_and_lose_nothing():
    rng = np.random.default_rng(2)
    less = 0
    for _ in range(60):
        docs, units = 400, [(0, 1), (2, 3), (4, 5), (6,)]
        places = {t: np.sort(rng.choice(docs, int(rng.integers(1, 40 if t < 6 else 300)), replace=False)) for t in range(7)}
        impacts = {t: rng.integers(1, 1000 if t < 6 else 60, len(p)) for t, p in places.items()}
        shard = lexical.Postings(docs, places, impacts, {})
        alone = [(t,) for t in range(7)]
        joint = {}
        for pair in units[:3]:
            both = shard.intersection(*pair)[1]
            if len(both):
                joint[pair] = int(both.max())
        paired = lexical.Postings(docs, places, impacts, joint)
        scores = np.zeros(docs, dtype=np.int64)
        for t in range(7):
            scores[places[t]] += impacts[t]
        for pair in units[:3]:
            sums = np.zeros(docs, dtype=np.int64)
            for t in pair:
                sums[places[t]] += impacts[t]
            assert sums.max() == paired.bound(pair) <= sum(paired.bound((t,)) for t in pair)
        order = np.lexsort((np.arange(docs), -scores))[:10]
        threshold = int(scores[order[-1]])
        a, b = shard.best(alone, 10, threshold), paired.best(units, 10, threshold)
        for found in (a, b, paired.best(units, 10, 0)):
            assert found[0].tolist() == order.tolist() and found[1].tolist() == scores[order].tolist()
        less += b[2] < a[2]
        assert len(paired.best(units, 10, int(scores.max()) + 1)[0]) == 0
    assert less > 20


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    expected = sorted(con.execute(ORACLES["op13_pair_maxscore"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op13_pair_maxscore"](spark, folder).collect()) == expected
