"""Digests over one canonical form, and codecs of posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest(*columns: Column) -> Column:
    """SHA-256 over the values joined by unit separators; null is written as a record separator."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x1e")) for c in columns)), 256)


def manifest(key: Column, value: Column) -> Column:
    """An aggregate: one digest of all (key, value) pairs in key order."""
    rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws("=", r["k"].cast("string"), r["v"].cast("string"))), "\n"), 256)


def capsule_key(source: Column, revision: Column) -> Column:
    return F.concat_ws("@", source, revision)


def encode_ids(ids: list[int]) -> bytes:
    """Gaps of ascending ids, seven bits a byte, the last byte of a number marked."""
    out, last = bytearray(), 0
    for i in ids:
        gap = i - last
        if gap <= 0:
            raise ValueError("ids have to ascend from 1")
        last, low = i, []
        while True:
            low.append(gap & 127)
            gap >>= 7
            if not gap:
                break
        low[0] |= 128
        out += bytes(reversed(low))
    return bytes(out)


def decode_ids(data: bytes) -> list[int]:
    out, gap, last = [], 0, 0
    fresh = True
    for b in data:
        if fresh and b == 0:
            raise ValueError("a number begins with a zero byte")
        fresh = bool(b & 128)
        gap = gap << 7 | b & 127
        if fresh:
            if not gap:
                raise ValueError("a gap of zero")
            last += gap
            out.append(last)
            gap = 0
    if not fresh:
        raise ValueError("the last number is cut")
    return out


@F.pandas_udf(T.BinaryType())
def packed_ids(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in lists:
        yield s.map(lambda x: encode_ids([int(i) for i in x]))


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpacked_ids(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in blobs:
        yield s.map(decode_ids)
