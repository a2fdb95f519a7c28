"""SimHash classes against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vozlake.llm import simhash
from vozlake.llm.dealing import attach

WORDS = re.compile("[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=4):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(max(len(words) - k, 0) + 1)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(codes, distance):
    codes = list(codes)
    label = list(range(len(codes)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(codes)):
        out.setdefault(root(i), set()).add(codes[i])
    return sorted(map(sorted, out.values()))


def near_codes(rnd, families=25, members=14):
    out = set()
    for _ in range(families):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randrange(members)):
            code = base
            for _ in range(rnd.randrange(7)):
                code ^= 1 << rnd.randrange(64)
            out.add(code)
            base = rnd.choice([base, code])
    return out | {0, (1 << 64) - 1, 15, 31}


def test_gray_rank():
    n = np.arange(64, dtype=np.uint64)
    assert simhash.gray_rank(n ^ (n >> np.uint64(1))).tolist() == n.tolist()


@pytest.mark.parametrize("distance", [0, 1, 4, 9])
def test_index(distance, monkeypatch):
    rnd = random.Random(distance)
    monkeypatch.setattr(simhash, "ASKERS", 37)
    monkeypatch.setattr(simhash, "STEPS", 400)
    for codes in (near_codes(rnd), set(range(300)), {rnd.getrandbits(64) for _ in range(200)}, {7}):
        index = simhash.GrayIndex(np.array(sorted(codes), dtype=np.uint64))
        found = {}
        for code, label in zip(index.codes.tolist(), index.classes(distance).tolist()):
            found.setdefault(label, set()).add(code)
        assert sorted(map(sorted, found.values())) == brute_classes(sorted(codes), distance)


def test_walk_gives_exactly_the_near_pairs():
    codes = np.array(sorted(near_codes(random.Random(3))), dtype=np.uint64)
    index = simhash.GrayIndex(codes)
    apart = np.arange(len(codes))  # every fingerprint a class of its own
    got = {(a, b) for who, met in index.near(apart, 4, apart) for a, b in zip(who.tolist(), met.tolist())}
    values = index.codes.tolist()
    assert got == {(a, b) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 4}


def signed(code):
    return code - (1 << 64) if code >> 63 else code


@pytest.mark.parametrize("limit", [30, 8192])
def test_groups_lose_no_pair(spark, limit):
    """Groups of many alike fingerprints are dealt again, and stay below the limit."""
    codes = near_codes(random.Random(6), 8) | set(range(40))
    rows = spark.createDataFrame([(signed(c),) for c in codes], "_code long")
    dealt = simhash.groups(rows, 4, limit).collect()
    met, sizes = set(), {}
    for r in dealt:
        sizes.setdefault((r._mask, r._value), set()).add(r._code & (1 << 64) - 1)
        assert r._code & r._mask == r._value
    for group in sizes.values():
        assert len(group) <= limit
        met |= {(a, b) for a in group for b in group if a < b and (a ^ b).bit_count() <= 4}
    assert met == {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 4}


SCHEMA = "doc_id long, text string, lang string, _code long, fingerprint string, component_id string"


@pytest.mark.parametrize("limit", [8192])
def test_classes(spark, limit):
    rnd = random.Random(9)
    texts = [None, "", " \n", "a", "A", "a b c", "a b c d", "é ü\tñ Ñ é", "x " * 900]
    for _ in range(25):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(30, 300))]
        for _ in range(rnd.randrange(1, 5)):
            texts.append(" ".join(words))
            words[rnd.randrange(len(words))] = "changed"
    rows = [(i if i % 11 else None, t, "en", 5, "clash", "clash") for i, t in enumerate(texts)] + [(20, texts[20], "de", 5, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    codes = {t: brute_fingerprint(t) for _, t, *_ in rows}
    least = {}
    for members in brute_classes(sorted(set(codes.values())), 4):
        ids = [k for k, t, *_ in rows if codes[t] in members and k is not None]
        least |= dict.fromkeys(members, min(ids) if ids else None)
    expected = sorted(str((k, f"{codes[t]:016x}", least[codes[t]])) for k, t, *_ in rows)
    assert sorted(str(tuple(r)) for r in simhash.classes(docs, limit=limit).collect()) == expected
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_attach_splits_hot_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, 1).when(F.col("id") < 4990, F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("id").alias("least")).filter("k is not null")
    out = attach(rows, table, "k")
    assert out.count() == 5000 and out.filter("least is null").count() == 10
    assert out.filter("k = 1 and least = 0").count() == 4000 and out.filter("k > 1 and least = k").count() == 990
