"""Secret scans with multipart credential linking, in DataFrame operations only.

Three strong patterns (assigned values, access keys, long hex) are reported wherever they are. Weak candidates, namely account
identifiers, bare random-looking tokens and endpoints, are common in clean text, so they are reported only when complementary parts
co-occur: an interval join within a scope of ``SCOPE`` characters links an identifier with a secret, and an endpoint with both.
The scope is the gap between the end of one part and the start of the other, whatever their lengths. The join is on (text, side,
scope cell), where a cell is ``SCOPE`` characters long: a part looks for ends in the cell of its start and the one before, and for
starts in the cell of its end and the one after; a cell holds a bounded number of parts because parts don't overlap within a kind.

Offsets come from the text between matches: the lengths of gaps and matches are summed in order. Texts are told apart by
SHA-256, so copies are linked once.

Rows: a null text is empty; keys may repeat or be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vozlake.durable import cut

#: characters within which parts belong together
SCOPE = 200
REDACTED = "[SECRET]"
#: order of kinds in results; the first three are the strong ones
KINDS = ("assign", "access", "hex", "account", "token", "endpoint")

#: kind: (pattern, group whose length counts, least length)
_PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "account": (r"""(?i)\b(?:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 0, 1),
    # '=' may stand before a token and pads it; a name right before '=value' is none. Possessive, so that long tokens take linear time
    "token": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])(?=[0-9A-Z+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_-])", 0, 1),
    "endpoint": (r"""(?i)\b[a-z][a-z0-9+]{1,9}://[^\s"'<>]{4,}""", 0, 1),
}
#: what cheaply shows that a pattern may match
_HINTS = {"hex": r"[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}"}
#: the parts a kind can be
_IDENTIFIERS, _SECRETS = ("access", "account"), ("assign", "hex", "token")


def _measured(text: Column, kind: str) -> Column:
    """array<struct<kind, pos, gap, length, counts>> of a pattern's matches, in order; null if none."""
    pattern, group, _ = _PATTERNS[kind]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(F.arrays_zip(found.alias("m"), values.alias("v"), gaps.alias("g")), lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("pos"), F.length(x["g"]).alias("gap"),
        F.length(x["m"]).alias("length"), F.length(x["v"]).alias("counts")))
    # there is one gap more than matches; its row has no length
    return F.when(text.rlike(_HINTS.get(kind, pattern)), F.filter(rows, lambda x: x["length"].isNotNull()))


def _spans(parts: DataFrame) -> DataFrame:
    """(_digest, kind, start, end) of the matches that are long enough, from measured ones."""
    before = Window.partitionBy("_digest", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("length")).over(before)
    least = F.element_at(F.array(*[F.lit(_PATTERNS[k][2]) for k in KINDS]), F.col("kind") + 1)
    return parts.withColumn("end", end).filter(F.col("counts") >= least).select(
        "_digest", "kind", (F.col("end") - F.col("length")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def _kind_in(names: Sequence[str], column: str = "kind") -> Column:
    return F.col(column).isin([KINDS.index(n) for n in names])


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that have their complementary parts apart from them, at most ``scope`` characters away."""
    cell = lambda at: F.floor(F.col(at) / scope)
    weak = spans.filter(_kind_in(KINDS[3:]))
    side = lambda name, *cells: [F.struct(F.lit(name).alias("_side"), c.alias("_cell")) for c in cells]
    near = weak.select("*", F.inline(F.array(
        *side("before", cell("start") - 1, cell("start")), *side("after", cell("end"), cell("end") + 1))))
    other = spans.filter(~_kind_in(["endpoint"])).select("_digest", F.col("kind").alias("_kind"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    other = other.select("*", F.inline(F.array(*side("before", cell("_end")), *side("after", cell("_start")))))
    gap = F.when(F.col("_side") == "before", F.col("start") - F.col("_end")).otherwise(F.col("_start") - F.col("end"))
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    seen = near.join(other, ["_digest", "_side", "_cell"]).filter(gap.between(0, scope)).groupBy("_digest", "kind", "start", "end").agg(
        flag(_kind_in(_IDENTIFIERS, "_kind")).alias("_id"), flag(_kind_in(_SECRETS, "_kind")).alias("_secret"))
    complete = (
        (_kind_in(["account"]) & (F.col("_secret") == 1)) | (_kind_in(["token"]) & (F.col("_id") == 1))
        | (_kind_in(["endpoint"]) & (F.col("_id") == 1) & (F.col("_secret") == 1))
    )
    return seen.filter(complete).select("_digest", "kind", "start", "end")


def _without_strong_overlap(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """Weak spans that no strong span overlaps: the last strong end before a weak span's end must not pass its start."""
    both = weak.withColumn("_weak", F.lit(1)).unionByName(strong.withColumn("_weak", F.lit(0)))
    upto = Window.partitionBy("_digest").orderBy("start", "_weak").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("_digest").orderBy("start", "_weak").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    last = F.max(F.when(F.col("_weak") == 0, F.col("end"))).over(upto)
    following = F.min(F.when(F.col("_weak") == 0, F.col("start"))).over(after)
    clear = both.withColumn("_last", last).withColumn("_next", following).filter(
        (F.col("_weak") == 1) & (F.coalesce("_last", F.lit(-1)) <= F.col("start"))
        & (F.col("_next").isNull() | (F.col("_next") >= F.col("end"))))
    return clear.select("_digest", "kind", "start", "end")


def _found(texts: DataFrame, scope: int) -> tuple[DataFrame, DataFrame]:
    """A stored stage of the other columns of ``texts`` with _digest for _text, and (_digest, base, spans) of texts with any."""
    found = [F.coalesce(_measured(F.col("_text"), k), F.array().cast("array<struct<kind:int,pos:int,gap:int,length:int,counts:int>>")) for k in KINDS]
    others = [c for c in texts.columns if c != "_text"]
    staged = cut(texts.withColumn("_parts", F.concat(*found)).select(*others, digest_of("_text"), "_parts"), "secrets")
    distinct = staged.filter(F.size("_parts") > 0).groupBy("_digest").agg(F.any_value("_parts").alias("_parts"))
    spans = cut(_spans(distinct.select("_digest", F.inline("_parts"))), "spans")
    strong = spans.filter(_kind_in(KINDS[:3]))
    weak = linked(_without_strong_overlap(spans.filter(_kind_in(KINDS[3:])), strong).unionByName(strong), scope)
    row = F.struct("start", "kind", "end")
    joined = strong.withColumn("_base", F.lit(True)).unionByName(weak.withColumn("_base", F.lit(False))).groupBy("_digest").agg(
        F.array_sort(F.collect_list(F.when(F.col("_base"), row))).alias("base"), F.array_sort(F.collect_list(row)).alias("spans"))
    return staged, joined


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("_digest")


_NONE = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document: key, ``base`` and ``spans``: arrays of struct<start, kind, end> (kind as its place in ``KINDS``), by start
    and then kind; code points, end exclusive."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    staged, joined = _found(docs.select(F.col(key).alias("_key"), body.alias("_text")), scope)
    return staged.join(joined, "_digest", "left").select(
        F.col("_key").alias(key), F.coalesce("base", F.array().cast(_NONE)).alias("base"),
        F.coalesce("spans", F.array().cast(_NONE)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The per-document digest columns of :func:`scan`."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(key, *[count(k) for k in KINDS[:3]], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = REDACTED, scope: int = SCOPE) -> DataFrame:
    """All columns of ``docs``, with ``mark`` in place of each stretch of text that spans cover. A null text stays null."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    _, joined = _found(docs.select(body.alias("_text")), scope)
    found = docs.withColumn("_digest", digest_of(text)).join(joined.select("_digest", "spans"), "_digest", "left")
    return found.withColumn(text, covered(F.col(text), F.col("spans"), mark)).select(*docs.columns)


def covered(text: Column, spans: Column, mark: str = REDACTED) -> Column:
    """The text with ``mark`` for each stretch of touching or overlapping spans (by start)."""
    struct = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    # a span that begins before the last stretch ends widens it
    cover = F.aggregate(spans, empty, lambda got, x: F.when(
        (F.size(got) > 0) & (F.element_at(got, -1)["end"] >= x["start"]),
        F.concat(F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0))), F.array(struct(
            F.element_at(got, -1)["start"], F.greatest(F.element_at(got, -1)["end"], x["end"])))),
    ).otherwise(F.concat(got, F.array(struct(x["start"], x["end"])))))

    def rebuilt(c: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(c, F.greatest(i, F.lit(1)))["end"])
        pieces = F.transform(c, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["start"] - before(i)), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(c, -1)["end"] + 1, F.length(text)))

    # a one-element transform names the cover, so that it is worked out once
    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(cover), rebuilt), 1)).otherwise(text)
