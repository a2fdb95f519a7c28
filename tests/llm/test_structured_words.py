"""Words, lines and pieces whose bytes follow a pattern, settings with units and column names that need quotes."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from vozlake.llm import jaccard, packing, quality, severity, substring, textscan as ts, tokenfile, tokens


def morse(bits, zero="a", one="b"):
    value = zero
    for _ in range(bits):
        value += value.translate(str.maketrans(zero + one, one + zero))
    return value


def flipped(text, zero="a", one="b"):
    return text.translate(str.maketrans(zero + one, one + zero))


@pytest.mark.parametrize("bits", [2, 4, 6, 7, 8, 9, 10, 12, 14, 20])
def test_pattern_and_complement_differ(bits):
    pairs = [f"{x} {y} {x}" for x, y in ((morse(bits), flipped(morse(bits))), (morse(bits, "a", "c"), flipped(morse(bits, "a", "c"), "a", "c")))]
    for chunk in ts.chunks(pa.array(pairs)):
        h = ts.words(chunk).hashes
        assert all(h[i] == h[i + 2] and h[i] != h[i + 1] for i in range(0, len(h), 3))
        assert (ts.words(chunk, folded=True).hashes == h).all()


def test_hash_reads_every_byte_and_its_place():
    rng = np.random.default_rng(5)
    seen = collections.defaultdict(set)
    for n in (1, 7, 8, 9, 16, 17, 63, 64, 255, 256, 257, 1000):
        base = rng.integers(97, 100, n).astype(np.uint8)
        for i in range(n):
            other = base.copy()
            other[i] ^= 4
            seen[int(ts.span_hashes(other, np.array([0]), np.array([n]))[0])].add(other.tobytes())
        padded = np.concatenate([[9], base, [7]]).astype(np.uint8)
        assert ts.span_hashes(padded, np.array([1]), np.array([n + 1]))[0] == ts.span_hashes(base, np.array([0]), np.array([n]))[0]
        upper = np.frombuffer(base.tobytes().upper(), dtype=np.uint8)
        assert ts.span_hashes(upper, np.array([0]), np.array([n]), folded=True)[0] == ts.span_hashes(base, np.array([0]), np.array([n]))[0]
    assert all(len(v) == 1 for v in seen.values())


@pytest.mark.parametrize("n", [70, 1024, 4096])
def test_window_hashes_of_patterns(n):
    x, y = np.uint64(3), np.uint64(11)
    values = np.array([x if c == "a" else y for c in (morse(12) + flipped(morse(12)))], dtype=np.uint64)
    by_hash = collections.defaultdict(set)
    for i, h in enumerate(ts.grams(values, n).tolist()):
        by_hash[h].add(values[i:i + n].tobytes())
    assert all(len(v) == 1 for v in by_hash.values())


@pytest.fixture(scope="module")
def patterned(spark):
    rows = []
    for bits in (10, 12, 14):
        x, y = morse(bits), flipped(morse(bits))
        rows += [" ".join([x, *[f"p{i}" for i in range(40)]]), " ".join([y, *[f"p{i}" for i in range(40, 80)]]),
                 f"{x}\n{y}\n{x}\nend", " ".join([x] * 41), " ".join([y] * 41)]
    # 35 words each, of which no two windows are equal
    rows += [" ".join(morse(10) if c == "a" else flipped(morse(10)) for c in w) for w in (morse(5) + "abc"[:2] + "a" * 9, flipped(morse(5)) + "b" * 9)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)


def test_substring(patterned):
    words = [(r.doc_id, r.text.split()) for r in patterned.collect()]
    seen = collections.Counter(tuple(w[i:i + 35]) for _, w in words for i in range(len(w) - 34))
    expected = {}
    for key, w in words:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        expected[key] = (len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring.deduplicate(patterned).collect()} == expected


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens(name, patterned):
    texts = [r.text for r in patterned.collect()]
    tokenizer = tokens.PieceTokenizer(tokens.vocabulary(name))
    for _ in range(2):
        for first, ids, counts in tokenizer.texts(pa.array(texts), 7):
            ends = np.cumsum(counts)
            for i, (end, n) in enumerate(zip(ends, counts)):
                assert ids[end - n:end].tolist() == [*tokenizer.encode(texts[first + i]), 7]


def test_a_piece_with_the_key_of_another_is_encoded_anew():
    tokenizer = tokens.PieceTokenizer(tokens.vocabulary("byte_bpe_50k.json"))
    (chunk,) = ts.chunks(pa.array(["one two"]))
    tokenizer.chunk_ids(chunk)
    tokenizer.checks ^= np.uint64(1)  # as if other pieces had these keys
    before = len(tokenizer.keys)
    ids, _ = tokenizer.chunk_ids(chunk)
    assert ids.tolist() == tokenizer.encode("one two").tolist() and len(tokenizer.keys) == before


def test_sets_and_lines(patterned):
    rows = {r.doc_id: r.text for r in patterned.collect()}
    sets = {k: {tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)} for k, t in rows.items()}
    joined = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(patterned, words=3, percent=90).collect()}
    assert {k: v[0] for k, v in joined.items()} == {k: len(s) for k, s in sets.items()}
    link = lambda a, b: 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])
    assert {k: v[1] for k, v in joined.items()} == {k: min(o for o in sets if link(k, o)) for k in sets}
    (chunk,) = ts.chunks(pa.array([f"{morse(b)}\n{flipped(morse(b))}\n{morse(b)}" for b in (9, 10, 13)]))
    assert quality.duplicate_lines(chunk).tolist() == [1, 1, 1]


@pytest.mark.parametrize("setting,size", [("64m", 64 << 20), ("64MB", 64 << 20), ("1024", 1024), ("8388608b", 8 << 20), ("1g", 1 << 30)])
def test_settings_with_units(spark, setting, size):
    assert ts.size_of(setting) == size
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, setting)
        ts.bounded_batches(spark)
        assert 0 < ts.size_of(spark.conf.get(name)) <= ts.BATCH_BYTES
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", ["doc id", "select", "a-b"])
def test_names_that_need_quotes(spark, name):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, None, None)], f"`{name}` long, text string, lang string")
    assert {r[name] for r in packing.pack(docs, key=name).collect()} == {1, 2}
    assert {r[name] for r in tokenfile.round_trip(docs, key=name).collect()} == {1, 2}
    assert {r[name] for r in quality.rules(docs, key=name).collect()} == {1, 2}
    assert {r[name] for r in substring.deduplicate(docs, key=name).collect()} == {1, 2}
    assert {r[name] for r in jaccard.join(docs, key=name).collect()} == {1, 2}


def test_fitted_rows_are_bounded(spark):
    docs = spark.createDataFrame([(k % 3, f"text number {k} of words") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    original = severity.fit_weights
    severity.fit_weights = lambda rows, columns, y, size: seen.append(len(y)) or original(rows, columns, y, size)
    try:
        severity.fit(docs, labels, severity.label_grade(), max_labelled=2)
    finally:
        severity.fit_weights = original
    assert seen == [2]
