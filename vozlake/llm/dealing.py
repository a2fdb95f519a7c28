"""Dealing hashes into buckets by value, many to a row.

A task that has many hashes for the same bucket sends them as one ascending, delta-coded list, which takes about half the bytes
of a row each, and sends a hash once however often it met it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vozlake.durable import cut

#: leading bits of a hash that name its bucket
EDGE_BITS = 24


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as the low bytes of each and the differences of the rest, which are small."""
    n = len(values)
    if n == 0:
        return struct.pack("<IBB", 0, 0, 1)
    gap = (int(values[-1]) - int(values[0])) // n
    low = min(gap.bit_length() // 8, 7)
    high = values >> np.uint64(8 * low)
    steps = np.diff(high, prepend=np.uint64(0))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(steps) or int(steps[1:].max(initial=0)) < 1 << (8 * w))
    head = struct.pack("<IBBQ", n, low, width, int(steps[0]))
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(n, 8)[:, :low]
    return head + steps[1:].astype(f"<u{width}").tobytes() + raw.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    n, low, width = struct.unpack_from("<IBB", raw)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    steps = np.empty(n, dtype=np.uint64)
    steps[0] = struct.unpack_from("<Q", raw, 6)[0]
    at = 14 + width * (n - 1)
    steps[1:] = np.frombuffer(raw, dtype=f"<u{width}", count=n - 1, offset=14)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :low] = np.frombuffer(raw, dtype=np.uint8, offset=at).reshape(n, low) if low else 0
    return out.view("<u8").reshape(n) + (np.cumsum(steps) << np.uint64(8 * low))


def by_bucket(values: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that ascending values of ``bits`` bits fall into, and the stretch of each."""
    of = ((values >> np.uint64(bits - EDGE_BITS)) * np.uint64(buckets)) >> np.uint64(EDGE_BITS)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(of))
    for b, low, high in zip(of[first].tolist(), first.tolist(), last.tolist()):
        yield int(b), slice(low, high)


def with_repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending values: the distinct ones, and those met twice or more."""
    if not len(values):
        return values, values
    new = np.concatenate([[True], values[1:] != values[:-1]])
    return values[new], np.unique(values[1:][~new[1:]])


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


#: a key with more than one in so many rows is hot
HOT_SHARE = 1000


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows with the other columns of ``table``, which has one row per non-null ``key`` and in ``_n`` how many rows have it.

    Fewer than HOT_SHARE keys can have more than one in HOT_SHARE of the rows; these are broadcast, so no task gets all rows of one."""
    stored = cut(table, "attached")
    total = stored.agg(F.sum("_n")).first()[0] or 0
    values = [c for c in stored.columns if c not in (key, "_n")]
    is_hot = F.col("_n") * HOT_SHARE > total
    hot = stored.filter(is_hot).select(key, *values, F.lit(True).alias("_hot"))
    cold = stored.filter(~is_hot).select(key, *values)
    met = rows.join(F.broadcast(hot), key, "left")
    rest = met.filter(F.col("_hot").isNull()).select(*rows.columns).join(cold, key, "left")
    return met.filter(F.col("_hot")).select(*rows.columns, *values).unionByName(rest.select(*rows.columns, *values))
