"""Training-data operators against brute force on small fixtures with nulls, ties, repeats, empty and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vozlake.durable import scratch
from vozlake.llm import (
    decontaminate, fixity, jaccard, packing, quality, secrets, severity, substring, tokenfile, tokens, urls,
)
from vozlake.llm.components import components
from vozlake.llm.dealing import pack_sorted, unpack_sorted

WORDS = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words long, _text string, ids string"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    some = [" ".join(rnd.choice("abcde") + rnd.choice("xyz") for _ in range(rnd.randrange(0, 90))) for _ in range(60)]
    long = " ".join(f"w{i % 701}" for i in range(6000))
    return [*some, *some[:12], *[some[3]] * 5, None, "", " \t\n", "one", "ONE", "é ü\nñ\nñ\n", long, long + " end", "a  b c  d <|endoftext|> x"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i % 17 else None, t, ("en", "de", None)[i % 3], 1, "clash", "clash") for i, t in enumerate(texts)]
    rows += rows[4:6]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("window", [2, 5, 35])
def test_substring(docs, empty, window):
    words = [(k, t.encode().split()) for k, t in given(docs)]
    seen = collections.Counter(tuple(w[i:i + window]) for _, w in words for i in range(len(w) - window + 1))
    expected = []
    for key, w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert rows_of(substring.deduplicate(docs, window=window, bucket_bytes=3000, with_text=True)) == sorted(expected, key=str)
    assert substring.deduplicate(empty).count() == 0


def test_sorted_lists():
    rng = np.random.default_rng(3)
    for bits, n in itertools.product((1, 9, 33, 63), (0, 1, 2, 300)):
        values = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64))
        assert (unpack_sorted(pack_sorted(values)) == values).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name):
    import pyarrow as pa

    rnd = random.Random(1)
    alphabet = [*"ab 's\n\t\r9,!Σ", "é", " ", "́", " ", "　", "\u0085", "\x1c", "<|endoftext|>"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(1500)]
    tokenizer = tokens.PieceTokenizer(tokens.vocabulary(name))
    for first, ids, counts in tokenizer.texts(pa.array(texts), 7):
        ends = np.cumsum(counts)
        for i, (end, n) in enumerate(zip(ends, counts)):
            assert ids[end - n:end].tolist() == [*tokenizer.encode(texts[first + i]), 7]


def test_packing(docs, empty):
    out = packing.pack(docs, with_ids=True).collect()
    tokenizer = tokens.of_worker(packing.VOCABULARY)
    expected = collections.Counter((k, hashlib.sha256(np.append(tokenizer.encode(t), 0).astype("<u4").tobytes()).hexdigest()) for k, t in given(docs))
    total = sum(r.length for r in out)
    by_sequence = collections.defaultdict(list)
    for r in out:
        assert r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert r.length == 2048 or r.piece == 0
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1
    single = collections.Counter((r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in out if r.start == 0 and r.length < 2048)
    assert all(single[k] <= n for k, n in expected.items() if k in single) and sum(r.piece == 0 for r in out) == sum(expected.values())
    assert packing.pack(empty).count() == 0
    joined = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert sum(r.length for r in joined) == total and all(len(r["ids"]) == 4 * r.length for r in joined)


def test_plan_is_exact_on_counts():
    rng = np.random.default_rng(5)
    counts = np.zeros(2049, dtype=np.int64)
    counts[rng.integers(1, 2049, 200)] = rng.integers(1, 5000, 200)
    plan = packing.plan(counts)
    filled = collections.Counter()
    for length in np.flatnonzero(counts):
        a, b = plan.first[length], plan.first[length + 1]
        ends = np.append(plan.low[a + 1:b], counts[length])
        for i, end in zip(range(a, b), ends):
            ranks = np.arange(end - plan.low[i])
            for s, n in zip(*np.unique(plan.sequence[i] + ranks // plan.each[i], return_counts=True)):
                filled[s] += int(n) * int(length)
    assert max(filled.values()) <= 2048 and sum(filled.values()) == int((counts * np.arange(2049)).sum())
    assert len(filled) == plan.sequences


def test_token_files(spark, docs, empty):
    files = tokenfile.write(docs, scratch(spark, "files"), block_ids=500)
    out = tokenfile.read(spark, files, with_ids=True).orderBy("start").collect()
    tokenizer = tokens.of_worker(tokenfile.VOCABULARY)
    keys = [r.doc_id for r in out]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    place = 0
    for r in out:
        assert r.start == place and r.n_tokens * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
        place += r.n_tokens
    expected = sorted((str(k), np.append(tokenizer.encode(t), 2).astype("<u4").tobytes()) for k, t in given(docs))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in out) == expected
    assert tokenfile.round_trip(empty).count() == 0
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 3, 9], dtype=np.uint32)
    assert tokenfile.decode(*tokenfile.encode(values), len(values)).tolist() == values.tolist()


def shingles(text, k):
    w = WORDS.findall(fold(text))
    return frozenset(tuple(w[j:j + k]) for j in range(max(len(w) - k, 0) + 1)) if w else frozenset()


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, empty, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_HASHES", 500)
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefghijklmnop") + rnd.choice("xyz") for _ in range(rnd.randrange(3, 60))] for _ in range(12)]
    found = []
    for i in range(250):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"q{rnd.randrange(50)}"
        found.append((i, " ".join(w)))
    found += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "one  two")]
    sets = {i: shingles(t or "", k) for i, t in found}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(found, "doc_id long, text string")
    assert rows_of(jaccard.join(docs, words=k, percent=percent)) == sorted(((i, len(s), root(i)) for i, s in sets.items()), key=str)
    assert jaccard.join(empty).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3), (2000, 2001)] * 2
    label = {}
    for a, b in [e for e in edges if None not in e and e[0] != e[1]]:
        x, y = label.get(a, {a}), label.get(b, {b})
        for node in (merged := x | y):
            label[node] = merged
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {n: min(s) for n, s in label.items()}


def test_quality(docs, empty):
    out = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.rules(docs).collect()}
    for key, t in given(docs):
        w = WORDS.findall(t)
        counts = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if counts[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = out[key, len(w), sum(map(len, w))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.rules(empty).count() == 0
    counts = np.array([[5, 5, 0], [1000, 0, 0]])
    reference = np.array([0.5, 0.5, 0.0])
    near, far = quality.distance(counts, reference)
    assert near == 0 and 0.5 < far < 0.6


def test_decontamination(spark, docs, empty):
    items = [(1, "AX by, cz; dx ey ax by cz dx ey ax"), (2, "one"), (None, "ñ"), (3, None), (3, "...")]
    items += [(9, next(t for _, t in given(docs) if t.count(" ") > 30)[:200])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    alnum = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = alnum.findall(fold(t or ""))
        for j in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[j:j + 10]), set()).add("" if i is None else str(i))
    expected = []
    for key, t in given(docs):
        w = alnum.findall(fold(t))
        hit, names = set(), set()
        for window, own in windows.items():
            for j in range(len(w) - len(window) + 1):
                if tuple(w[j:j + len(window)]) == window:
                    hit |= set(range(j, j + len(window)))
                    names |= own
        expected.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    for block in (40_000, 3):  # one automaton, and several blocks of windows
        decontaminate.BLOCK_WINDOWS = block
        assert rows_of(decontaminate.digests(decontaminate.contamination(docs, benchmark))) == sorted(expected, key=str)
    decontaminate.BLOCK_WINDOWS = 40_000
    spans = decontaminate.contamination(spark.createDataFrame([(1, "é ONE-two")], "doc_id long, text string"), benchmark).first().spans
    assert [tuple(s) for s in spans] == [(2, 5)]
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://a.net/fr/1", None), (2, "http://b.org/1", '<link href="http://a.net/fr/1" rel="canonical">'),
        (3, "http://c.org/x?utm_a=1", '<META http-equiv="refresh" content="0; URL=/y">'),
        (4, "https://www.C.org/y/#z", "<link rel=canonical href=//b.org/1>"),
        (5, "http://q.com/", "<link rel=canonical href=//b.org/1>"), (6, None, "x"), (7, "nope", None), (8, "http://c.org/zz", ""),
        (None, "http://www.example.com/en/a", ""), (9, "http://m.example.com/en/a", ""), (9, "http://x.com", ""),
    ], "page_id long, url string, html string")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {
        (1, "a.net"): ("/fr/1", "net/fr/", "block"), (2, "b.org"): ("/1", None, "block"), (3, "c.org"): ("/x", None, "block"),
        (4, "www.c.org"): ("/y/", None, "block"), (5, "q.com"): ("/", "com/", "allow"), (6, ""): ("", None, "allow"),
        (7, ""): ("", None, "allow"), (8, "c.org"): ("/zz", None, "allow"),
        (None, "www.example.com"): ("/en/a", "www.example.com/en/", "allow"),
        (9, "m.example.com"): ("/en/a", "example.com/en/", "block"), (9, "x.com"): ("", None, "allow"),
    }
    assert urls.judge(pages.limit(0)).count() == 0


PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def test_secrets(spark):
    weak = "Zx9" + "aB3dE5" * 4
    found = [
        (1, "é password = 'hunter2x' and token: ab token=abcdef, api_key=token:abcdef"), (2, "AKIA" + "Z9" * 8 + " x" + "0a" * 12),
        (3, None), (4, ""), (5, f"login: bob and {weak} at https://db.example.org/x"), (6, f"just {weak} here"), (7, "see https://db.example.org/x"),
        (8, "secret=" + "0a" * 20), (8, "secret=" + "0a" * 20), (None, "login: bob" + " " * 300 + weak),
    ]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    got = secrets.report(secrets.scan(docs)).collect()
    assert len(got) == len(found)
    texts = {k: t or "" for k, t in found}
    for r in got:
        base = sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(PATTERNS) for m in p.finditer(texts[r.doc_id]) if len(m.group(g)) >= n)
        written = ",".join(f"{k}:{a}:{e}" for a, _, e, k in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        kinds = [s.split(":")[0] for s in r.spans.split(",")] if r.spans else []
        assert kinds == (["account", "token", "endpoint"] if r.doc_id == 5 else [k for *_, k in base])
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[5] == "[SECRET] and [SECRET] at [SECRET]" and clean[6] == texts[6] and clean[3] is None
    assert clean[8] == "[SECRET]" and clean[1].startswith("é [SECRET]' and token: ab [SECRET],")


def test_severity_on_held_out_rows(spark):
    rnd = random.Random(4)
    found, labels = [], []
    for i in range(900):
        grade = rnd.choice([0, 0, 1, 2])
        w = ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(40)]
        w[:2 * grade] = [rnd.choice(["Moron", "scumbags", "moronic"]) for _ in range(2 * grade)]
        rnd.shuffle(w)
        found.append((i, " ".join(w)))
        labels.append((i, grade))
    found += [(None, None), (5000, "")]
    labels += [(None, 2), (3, None)]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = severity.fit(docs, table.filter("doc_id < 600 or doc_id is null"), F.col("toxic"))
    assert (np.diff(model.thresholds) > 0).all() and model.grades.tolist() == [0, 1, 2]
    out = {r.doc_id: r for r in severity.score(docs, model).collect()}
    held = [(g, out[i]) for i, g in labels if i is not None and i >= 600]
    assert np.mean([(r.p_toxic > 0.5) == (g > 0) for g, r in held]) > 0.98
    means = [np.mean([r.expected_severity for g, r in held if g == k]) for k in range(3)]
    assert means[0] < 0.3 < means[1] < means[2] and out[None].p_toxic < 0.5
    none = severity.fit(docs, table.limit(0), F.col("toxic"))
    assert severity.score(docs, none).filter("expected_severity > 0").count() == 0
    assert severity.score(docs.limit(0), model).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é body\r\n\r\nWARC/" + "z" * (i * 37 % 900)) for i in range(300)] + [(None, None, None)] * 3,
                                  "page_id long, url string, html string").coalesce(2)
    other = pages.withColumn("html", F.when(F.col("page_id").isin(7, 150), F.translate("html", "y", "Y")).otherwise(F.col("html")))
    a, b = (fixity.read_records(spark, fixity.write_warc(p, scratch(spark, "warc"), file_records=60)) for p in (pages, other))
    assert a.count() == pages.count()
    out = fixity.audit(a, b).collect()
    assert sorted((r.record_id, r.status) for r in out) == [("<urn:record:150>", "corrupt"), ("<urn:record:7>", "corrupt")]
    assert fixity.audit(a, a).count() == 0 and fixity.audit(a.limit(0), b.limit(0)).count() == 0
    lost = a.filter("record_id != '<urn:record:9>'")
    assert [(r.status, r.record_id) for r in fixity.audit(a, lost).collect()] == [("missing", "<urn:record:9>")]
    assert [r.status for r in fixity.audit(lost, a).collect()] == ["extra"]
    twice = a.unionByName(a.filter("record_id = '<urn:record:9>'"))
    assert {r.record_id for r in fixity.audit(a, twice).collect()} == {"<urn:record:9>"}
    odd = spark.createDataFrame([(None, None, None, None, None)] * 2, fixity.RECORD_SCHEMA)
    assert fixity.audit(odd, odd).count() == 0 and fixity.audit(odd, odd.limit(1)).count() == 1
    cut_off = list(fixity.parse_warc(iter([b"junk\r\n\r\nWARC/1.1\r\nContent-Length: 50\r\n\r\nshort"])))
    assert [x[:2] for x in cut_off] == [(0, 8), (8, 37)]
