"""The near-duplicate stage of the pipeline keeps one row of each component, whatever the keys."""

import collections
import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, _name string"


def brute(rows, words=5, percent=80):
    """Least (id, digest order is not fixed here) by component: the sets of texts that may stay, per component."""
    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i:i + words]) for i in range(max(len(w) - words, 0) + 1)) if w else frozenset()

    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a, *_r) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            x, y = shingles(a), shingles(b)
            if x and 100 * len(x & y) >= percent * len(x | y) or not x and not y and (a, rows[i][0]) == (b, rows[j][0]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[:2])
    return list(groups.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_one_row_stays(spark, seed, tmp_path):
    rnd = random.Random(seed)
    text = lambda n=40: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    t, u = text(), text()
    j = " ".join
    rows = [(1, j(t)), (None, j(t)), (None, j(u)), (5, j(t)), (6, j(t)), (6, j(u)), (6, j(u + ["q"])), (None, None), (None, None), (7, ""), (7, ""), (8, None)]
    for _ in range(30):
        base = text(60)
        for _ in range(rnd.randrange(1, 4)):
            rows.append((rnd.choice([None, *range(20, 40)]), j(base)))
            base = base + text(2)
    rows = [(*r, "en", "clash") for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert list(out[0].asDict()) == ["doc_id", "text", "lang", "_name"]
    groups = brute(rows)
    assert len(out) == len(groups)
    kept = collections.Counter((r.doc_id, r.text) for r in out)
    for group in groups:
        ids = [k for k, _ in group if k is not None]
        least = min(ids) if ids else None
        assert sum(min(kept[g], 1) for g in set(group) if g[0] == least) >= 1
