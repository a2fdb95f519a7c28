"""Bounded term tables as plan constants.

A model vocabulary or a language profile has a fixed maximum size, so it can sit
in the plan as a literal. Looking terms up row by row then needs neither a
shuffle nor a copy of the comment per exploded token. The literal is an array of
small arrays addressed by CRC-32. Maps would do too, but two equal map literals
do not compare as equal, and then no reader of a scored table shares a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from vozlake.functions.text import run_lengths

MAX_TERMS = 20_000


def _nested(groups: Iterable[list[str]]) -> str:
    """SQL of an array of arrays; an empty bucket holds one null so types agree."""
    return ",".join(f"array({','.join(g) or 'null'})" for g in groups)


class TermTable:
    def __init__(self, terms: Sequence[str], per_bucket: int = 2) -> None:
        if len(terms) > MAX_TERMS:
            raise ValueError(f"a term table holds at most {MAX_TERMS} terms, got {len(terms)}")
        if len(set(terms)) != len(terms):
            raise ValueError("terms must be unique")
        if any("'" in t or "\\" in t for t in terms):
            raise ValueError("terms may only contain word characters and blanks")
        self.terms = tuple(terms)
        self.n_buckets = max(1, len(terms) // per_bucket)
        buckets: list[list[tuple[str, int]]] = [[] for _ in range(self.n_buckets)]
        for position, term in enumerate(terms):
            buckets[zlib.crc32(term.encode()) % self.n_buckets].append((term, position))
        self._names = _nested(["'" + t + "'" for t, _ in b] for b in buckets)
        self._ids = _nested([str(i) for _, i in b] for b in buckets)

    def id_of(self, term: Column) -> Column:
        """Integer id of a term, null when it is not in the table."""
        bucket = (F.crc32(term) % F.lit(self.n_buckets)).cast("int")
        names, ids = F.expr(f"array({self._names})"), F.expr(f"array({self._ids})")
        return F.get(F.get(ids, bucket), F.array_position(F.get(names, bucket), term).cast("int") - 1)

    def counts(self, tokens: Column) -> Column:
        """array<struct<i int, tf int>>: matched terms with their frequency.

        Most tokens are no terms; a hash-set test drops them before any lookup.
        """
        known = F.filter(tokens, lambda t: t.isin(list(self.terms)))
        return run_lengths(F.sort_array(F.transform(known, self.id_of)))


def doubles(values: Sequence[float]) -> Column:
    """A literal array<double>, indexed by term id."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")
