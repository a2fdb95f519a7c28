"""Ranked lexical search: an inverted index in shards of documents, searched by MaxScore with bounds of term pairs.

Index. A shard is some 8 MB of documents; each of its terms has one row with the documents that hold it and how often. Queries come in
blocks of bounded size. For a block, its terms' rows are brought together by shard (one row each), with impacts, which are exact
integers. Neighbouring terms of a query, in order of their number of documents, make pairs (terms that many documents have stay alone). The
intersection list of each pair is computed once per shard: the documents that hold both, and the joint maximum impact of a document.

Search. The documents of the pair lists give each query a first threshold: the k-th highest sum of joint impacts over all shards, a
lower bound of its k-th highest score. In a shard, a pair is bounded by the largest of its two maxima and its joint maximum, which is far
less than their sum where both terms never meet. Pairs and single terms of the least bounds, as long as the bounds add up to less than
the threshold, can't bring in a document; only documents of the others are candidates. These are scored from the highest
bound down, and a candidate goes once its score and the bounds left are below the threshold. Thresholds rise from shard to shard of
a task. No document with a score at or above the k-th highest is ever skipped, so the result is exact, ties included.

A term is a run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.

Rows: each row of the query table is a query of its own; a null or empty text has no terms; a document without terms is not counted and
never found; keys may repeat, a null key counts as larger than all others; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vozlake.durable import cut
from vozlake.llm import textscan as ts

TOP = 10
#: text of a shard, unless one document has more; a worker holds a shard several times
SHARD_BYTES = 8 << 20
#: text of the queries of a block, unless one has more
BLOCK_BYTES = 1 << 20
#: a term that more than one in so many documents hold is in no pair
PAIR_SHARE = 8

_ROW = "shard long, term binary, n long, places binary, counts binary"


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _cells(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


class _Shard:
    """Documents of one shard while it is made."""

    def __init__(self) -> None:
        self.size = self.docs = 0
        self.ids, self.lengths, self.known, self.terms = [], [], np.zeros(0, np.uint64), []
        self.hashes, self.places, self.counts = [], [], []

    def add(self, chunk: ts.Chunk, ids: pa.Array) -> None:
        words = ts.words(chunk, ts.ALNUM, folded=True)
        having = np.flatnonzero(words.counts > 0)
        self.size += chunk.data.size
        if not len(having):
            return
        hashes, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(hashes, self.known))
        self.terms += [chunk.data[words.starts[i]:words.ends[i]].tobytes().lower() for i in first[new].tolist()]
        self.known = np.concatenate([self.known, hashes[new]])
        number = np.cumsum(words.counts > 0) - 1
        met, counts = np.unique(which * len(having) + number[words.doc], return_counts=True)
        self.hashes.append(hashes[met // len(having)])
        self.places.append(self.docs + met % len(having))
        self.counts.append(counts)
        self.ids.append(ids.take(pa.array(having)))
        self.lengths.append(words.counts[having])
        self.docs += len(having)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's own row (no term: ids and lengths of its documents by ascending key), then a row per term."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place_of = np.empty(len(order), dtype=np.int64)
        place_of[order] = np.arange(len(order))
        hashes, places, counts = (np.concatenate(x) for x in (self.hashes, self.places, self.counts))
        places = place_of[places]
        by_term = np.lexsort((places, hashes))
        hashes, places, counts = hashes[by_term], places[by_term], counts[by_term]
        edges = np.append(np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])), len(hashes))
        named = np.argsort(self.known)
        lengths = np.concatenate(self.lengths)[order].astype("<u4")
        names = ["shard", "term", "n", "places", "counts", "ids"]
        yield pa.RecordBatch.from_arrays([
            pa.array([shard]), pa.array([None], pa.binary()), pa.array([len(order)]), pa.array([lengths.tobytes()], pa.binary()),
            pa.array([None], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order)))], names)
        places, counts = _narrow(places), _narrow(counts)
        m = len(edges) - 1
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(m, shard)), pa.array([self.terms[i] for i in named.tolist()], pa.binary()), pa.array(np.diff(edges)),
            _cells(places, edges), _cells(counts, edges), pa.nulls(m, pa.list_(ids.type))], names)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stored stage: the index of all terms of all documents."""
    ts.bounded_batches(docs.sparkSession)
    given = docs.select(F.col(ts.quoted(key)).alias("_id"), F.col(ts.quoted(text)).cast("string").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for chunk in ts.chunks(batch.column(1)):
                shard.add(chunk, batch.column(0).slice(chunk.first, chunk.count))
                if shard.size >= shard_bytes:
                    if shard.docs:
                        yield from shard.rows(number)
                    shard, number = _Shard(), number + 1
        if shard.docs:
            yield from shard.rows(number)

    return cut(given.mapInArrow(run, f"{_ROW}, ids array<{kind}>"), "index")


@dataclass(frozen=True)
class Block:
    """Some queries: the numbers of their terms, in ascending order of documents, and which neighbours are pairs."""

    terms: list[np.ndarray]
    units: list[list[tuple[int, ...]]]
    weights: np.ndarray
    total_docs: int
    total_words: int

    def impacts(self, term: int, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if 90 * int(lengths.max(initial=0)) * self.total_docs < 1 << 63:
            m = 10 + 90 * lengths * self.total_docs // self.total_words
        else:
            m = np.array([10 + 90 * int(n) * self.total_docs // self.total_words for n in lengths], dtype=np.int64)
        return self.weights[term] * (1_000_000_000 * counts // (1000 * counts + 8 * m))

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return sorted({u for units in self.units for u in units if len(u) == 2})


def units_of(terms: Sequence[int], documents: Sequence[int], total: int) -> list[tuple[int, ...]]:
    """Terms of a query as pairs of neighbours in order of their number of documents; frequent ones and a last one stay alone."""
    order = sorted(terms, key=lambda t: (documents[t], t))
    rare = [t for t in order if documents[t] * PAIR_SHARE <= total]
    paired = [tuple(sorted(rare[i:i + 2])) for i in range(0, len(rare), 2)]
    return paired + [(t,) for t in order[len(rare):]]


@dataclass
class Postings:
    """One shard, for one block of queries: documents and impacts by term, and the joint maxima of pairs."""

    docs: int
    places: dict[int, np.ndarray]
    impacts: dict[int, np.ndarray]
    joint: dict[tuple[int, int], int]

    def bound(self, unit: tuple[int, ...]) -> int:
        """The most that the unit's terms add to a document's score."""
        own = [int(self.impacts[t].max()) for t in unit if t in self.impacts]
        return max(own + [self.joint.get(unit, 0)], default=0)

    def intersection(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with both terms, and what both add."""
        if a not in self.places or b not in self.places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, i, j = np.intersect1d(self.places[a], self.places[b], assume_unique=True, return_indices=True)
        return places, self.impacts[a][i] + self.impacts[b][j]

    def best(self, units: list[tuple[int, ...]], k: int, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k documents of highest score among those that reach the threshold (ties: ascending place), their scores, and how many
        postings were read."""
        bounded = sorted((b, u) for b, u in ((self.bound(u), u) for u in units) if b > 0)
        left = np.cumsum([b for b, _ in bounded]).tolist()
        threshold = max(threshold, 1)
        skipped = sum(total < threshold for total in left)
        scores, read = np.zeros(self.docs, dtype=np.int64), 0
        for _, unit in bounded[skipped:]:
            for t in unit:
                if t in self.places:
                    scores[self.places[t]] += self.impacts[t]
                    read += len(self.places[t])
        found = np.flatnonzero(scores)
        for n in range(skipped - 1, -1, -1):
            found = found[scores[found] + left[n] >= threshold]
            if not len(found):
                break
            for t in bounded[n][1]:
                if t not in self.places:
                    continue
                places = self.places[t]
                at = np.minimum(np.searchsorted(places, found), len(places) - 1)
                hit = places[at] == found
                scores[found[hit]] += self.impacts[t][at[hit]]
                read += len(found)
        found = found[scores[found] >= threshold]
        order = np.lexsort((found, -scores[found]))[:k]
        return found[order], scores[found[order]], read


def _prepared(index: DataFrame, hits: DataFrame, block: Block, k: int) -> DataFrame:
    """Stored stage: a row per shard with the impacts of the block's terms, its pair lists, and first scores from these lists."""
    kind = index.schema["ids"].dataType.simpleString()
    own = index.filter(F.col("term").isNull()).select("shard", F.lit(-1).alias("no"), "n", "places", "counts", "ids")
    # a shard without any term of the block has no answer
    rows = hits.select("shard", "no", "n", "places", "counts", F.lit(None).cast(kind).alias("ids")).unionByName(
        own.join(hits.select("shard").distinct(), "shard", "left_semi"))
    names = ["ids", "docs", "nos", "sizes", "places", "impacts", "pairs", "joint", "pair_sizes", "pair_places", "pair_impacts", "queries", "seeds"]
    schema = f"ids {kind}, docs long, " + ", ".join(f"{n} binary" for n in names[2:])

    def one(ids: pa.Array, lengths: np.ndarray, terms: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        shard = Postings(len(lengths), {}, {}, {})
        for no, n, places, counts in terms:
            shard.places[no] = _wide(places, n)
            shard.impacts[no] = block.impacts(no, _wide(counts, n), lengths[shard.places[no]])
        lists = {}
        for pair in block.pairs:
            places, both = shard.intersection(*pair)
            if len(places):
                lists[pair] = places, both
        queries, seeds = [], []
        for q, units in enumerate(block.units):
            known = [lists[u] for u in units if u in lists]
            if known:
                sums = np.zeros(shard.docs, dtype=np.int64)
                for places, both in known:
                    sums[places] += both
                top = np.sort(sums[sums > 0])[-k:]
                queries += [q] * len(top)
                seeds.append(top)
        flat = lambda parts, kind: b"".join(np.asarray(p).astype(kind).tobytes() for p in parts)
        cells = [
            flat([list(shard.places)], "<i4"), flat([[len(p) for p in shard.places.values()]], "<i8"),
            flat(shard.places.values(), "<u4"), flat(shard.impacts.values(), "<i8"),
            flat([np.array(list(lists)).reshape(-1, 2)], "<i4"), flat([[int(b.max()) for _, b in lists.values()]], "<i8"),
            flat([[len(p) for p, _ in lists.values()]], "<i8"), flat([p for p, _ in lists.values()], "<u4"), flat([b for _, b in lists.values()], "<i8"),
            flat([queries], "<i4"), flat(seeds, "<i8")]
        return pa.RecordBatch.from_arrays([ids, pa.array([shard.docs]), *(pa.array([c], pa.binary()) for c in cells)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, its own row first."""
        now, own, terms = None, None, []
        for batch in batches:
            for i, (shard, no, n, places, counts) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if shard != now:
                    if now is not None:
                        yield one(*own, terms)
                    now, terms = shard, []
                if no < 0:
                    own = batch.column(5).slice(i, 1), np.frombuffer(places, dtype="<u4").astype(np.int64)
                else:
                    terms.append((no, n, places, counts))
        if now is not None:
            yield one(*own, terms)

    by_shard = rows.repartition("shard").sortWithinPartitions("shard", "no")
    return cut(by_shard.mapInArrow(run, schema), "prepared")


def _thresholds(prepared: DataFrame, queries: int, k: int) -> dict[int, int]:
    """Per query the k-th highest first score, if there are so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [np.zeros(0, np.int64) for _ in range(queries)]
        for batch in batches:
            for q, s in zip(batch.column(0), batch.column(1)):
                of, scores = np.frombuffer(q.as_buffer(), dtype="<i4"), np.frombuffer(s.as_buffer(), dtype="<i8")
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
                for a, b in zip(first, [*first[1:], len(of)]):
                    tops[of[a]] = np.sort(np.concatenate([tops[of[a]], scores[a:b]]))[-k:]
        sizes = [len(t) for t in tops]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(queries), sizes), pa.int32()), pa.array(np.concatenate(tops))], ["query", "seed"])

    seeds = prepared.select("queries", "seeds").mapInArrow(run, "query int, seed long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("seed").desc()))
    return {r.query: r.seed for r in seeds.withColumn("_place", place).filter(F.col("_place") == k).collect()}


def _searched(prepared: DataFrame, block: Block, thresholds: dict[int, int], k: int) -> DataFrame:
    """(query, _id, score): per shard the best documents that reach the threshold of their query."""
    kind = prepared.schema["ids"].dataType.elementType.simpleString()

    def load(row: dict[str, bytes]) -> Postings:
        array = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        edges = np.cumsum(array("sizes", "<i8"))[:-1]
        nos = array("nos", "<i4").tolist()
        places = dict(zip(nos, np.split(array("places", "<u4").astype(np.int64), edges)))
        impacts = dict(zip(nos, np.split(array("impacts", "<i8"), edges)))
        joint = dict(zip(map(tuple, array("pairs", "<i4").reshape(-1, 2).tolist()), array("joint", "<i8").tolist()))
        return Postings(row["docs"], places, impacts, joint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = {q: np.zeros(0, np.int64) for q in range(len(block.units))}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = load({n: batch.column(n)[i].as_py() for n in ("docs", "nos", "sizes", "places", "impacts", "pairs", "joint")})
                ids, found, scores, queries = batch.column("ids")[i].values, [], [], []
                for q, units in enumerate(block.units):
                    known = reached[q]
                    least = max(thresholds.get(q, 0), int(known[0]) if len(known) == k else 0)
                    places, values, _ = shard.best(units, k, least)
                    reached[q] = np.sort(np.concatenate([known, values]))[-k:]
                    found.append(places)
                    scores.append(values)
                    queries.append(np.full(len(places), q))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(queries), pa.int32()), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))],
                    ["query", "_id", "score"])

    columns = ["ids", "docs", "nos", "sizes", "places", "impacts", "pairs", "joint"]
    return prepared.select(*columns).mapInArrow(run, f"query int, _id {kind}, score long")


def _blocks(queries: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """Query rows in blocks of bounded text; the driver holds one block."""
    given = queries.select(F.col(ts.quoted(item)), F.coalesce(F.col(ts.quoted(text)).cast("string"), F.lit("")))
    block, size = [], 0
    for row in given.toLocalIterator():
        if block and size + len(row[1]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += len(row[1]) + 64
    if block:
        yield block


def search(index: DataFrame, queries: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """Per query row: item, rank (from 1), key and score of the k documents of highest score above 0 (equal scores: ascending key)."""
    spark = index.sparkSession
    ts.bounded_batches(spark)
    totals = _totals(index)
    id_kind = index.schema["ids"].dataType.elementType
    item_kind = queries.schema[item].dataType
    out = None
    for rows in _blocks(queries, item, text):
        terms: dict[bytes, int] = {}
        asked = []
        for chunk in ts.chunks(pa.array([t for _, t in rows], pa.string())):
            starts, ends = ts.spans(chunk, ts.ALNUM)
            edges = np.searchsorted(starts, chunk.offsets)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                found = {chunk.data[starts[i]:ends[i]].tobytes().lower() for i in range(a, b)}
                asked.append([terms.setdefault(t, len(terms)) for t in sorted(found)])
        if not terms or not totals[0]:
            continue
        # the terms of one block
        wanted = spark.createDataFrame([(bytearray(t), n) for t, n in terms.items()], "term binary, no int")
        hits = cut(index.filter(F.col("term").isNotNull()).join(F.broadcast(wanted), "term").select("shard", "no", "n", "places", "counts"), "hits")
        documents = np.zeros(len(terms), dtype=np.int64)
        for no, n in hits.groupBy("no").agg(F.sum("n")).collect():
            documents[no] = n
        weights = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * int(n) + 1))) for n in documents], dtype=np.int64)
        present = [np.array([t for t in q if documents[t]], dtype=np.int64) for q in asked]
        block = Block(present, [units_of(q.tolist(), documents, totals[0]) for q in present], weights, *totals)
        prepared = _prepared(index, hits, block, k)
        found = _searched(prepared, block, _thresholds(prepared, len(rows), k), k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last()))
        names = spark.createDataFrame([(q, r[0]) for q, r in enumerate(rows)], f"query int, _item {item_kind.simpleString()}")
        ranked = found.withColumn("rank", place).filter(F.col("rank") <= k).join(F.broadcast(names), "query").select(
            F.col("_item").alias(item), "rank", F.col("_id").alias(key), "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = spark.createDataFrame([], f"{ts.quoted(item)} {item_kind.simpleString()}, rank int, {ts.quoted(key)} {id_kind.simpleString()}, score long")
    return out


def _totals(index: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(v.as_buffer(), dtype="<u4").sum(dtype=np.int64)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["n", "words"])

    own = index.filter(F.col("term").isNull()).select("n", "places").mapInArrow(run, "n long, words long")
    n, words = own.agg(F.sum("n"), F.sum("words")).first()
    return n or 0, words or 0
