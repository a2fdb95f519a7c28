"""Periodic runs against a brute force that tries every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from vozlake.llm import periodic


def brute(words, min_length=12):
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_length, 2 * p):
                best.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, m, p) for (s, m), p in best.items())


def test_covers_have_every_difference():
    for v, members in periodic.COVERS.items():
        assert {(a - b) % v for a in members for b in members} == set(range(v))


def sequences(rnd):
    yield []
    yield [0] * 11
    yield [0] * 500
    fib = [0], [0, 1]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]
    yield [bin(i).count("1") % 2 for i in range(700)]
    for _ in range(60):
        size = rnd.choice([1, 2, 3, 50])
        out = []
        while len(out) < rnd.choice([5, 60, 400]):
            part = [rnd.randrange(size) for _ in range(rnd.choice([1, 2, 5, 6, 7, 40]))]
            out += part * rnd.choice([1, 1, 2, 3, 20])
            out += out[len(out) // 2:][:rnd.choice([0, 3, 30])]
        yield out


@pytest.mark.parametrize("wide", [1 << 20, 10])
def test_runs(monkeypatch, wide):
    monkeypatch.setattr(periodic, "WIDE_FROM", wide)
    monkeypatch.setattr(periodic, "PAIRS", 300)
    every = list(sequences(random.Random(4)))
    first = np.concatenate([[0], np.cumsum([len(s) for s in every])])
    ids = np.array([w for s in every for w in s])
    for least in (4, 12):
        found = periodic.runs(ids, first, least)
        for d, s in enumerate(every):
            assert [tuple(r) for r in found[found[:, 0] == d][:, 1:].tolist()] == brute(s, least), (d, least)


def test_extensions_agree_with_comparison():
    rnd = random.Random(8)
    x = [5]
    for d in range(6):
        x += ([rnd.randrange(2) for _ in range(rnd.choice([3, 17]))] * 30)[:rnd.choice([40, 200])] + [10 + d]
    x = np.array(x)
    extend = periodic.Extensions(x)
    i, j = np.array([(a, b) for a in range(len(x)) for b in range(a + 1, len(x))]).T
    expected = []
    for a, b in zip(i.tolist(), j.tolist()):
        n = 0
        while b + n < len(x) and x[a + n] == x[b + n]:
            n += 1
        expected.append(n)
    assert extend(i, j).tolist() == expected


SCHEMA = "doc_id long, text string, lang string, n_runs long, _id string, `start` string"


def expected_row(key, text, loop):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(key).encode())
    if loop and key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (key, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("loop", [False, True])
def test_find(spark, loop):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a", "a " * 12, "a " * 11, "ab cd " * 6, "é ü\n" * 9, "x y z " * 400, "A a " * 8]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(80))) for _ in range(60)]
    texts += [" ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(300))) for _ in range(60)]
    rows = [(i if i % 13 else None, t, "en", 1, "clash", "clash") for i, t in enumerate(texts)] + [(4, texts[4], "en", 1, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = periodic.find(docs, arrange=periodic.looped if loop else None, with_runs=True, with_text=True).collect()
    got = sorted(tuple(r)[:9] for r in out if r.doc_id is not None)
    assert got == sorted(expected_row(k, t, loop) for k, t, *_ in rows if k is not None)
    assert sorted(map(str, (tuple(r)[:9] for r in out))) == sorted(str(expected_row(k, t, loop)) for k, t, *_ in rows)
    for r in out:
        assert r.n_runs == len(r.runs) and hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert periodic.find(spark.createDataFrame([], SCHEMA)).count() == 0
