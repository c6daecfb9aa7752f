"""Vectorised text kernels over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses."""
    if not _POWERS or len(_POWERS["p"]) < n:
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("p", _BASE), ("q", inv)):
            a = np.full(n, base, dtype=np.uint64)
            a[:1] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and ``len + 1`` offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; every row is in one."""
    n = len(column)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    a = 0
    while a < n:
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield a, b
        a = b


class Words:
    """Words of many texts: byte ranges, the text of each word and 64-bit hashes."""

    def __init__(self, column: pa.Array, hashes: bool = True):
        raw, at = utf8(column)
        self.data = LOWER[raw]
        self.docs = len(at) - 1
        self.at = at
        m = WORD[raw]
        before, after = np.empty_like(m), np.empty_like(m)
        if len(m):
            before[0], before[1:] = False, m[:-1]
            after[-1], after[:-1] = False, m[1:]
            cuts = at[1:-1]
            before[cuts[cuts < len(m)]] = False
            after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        #: first[d] to first[d + 1]: the words of text d
        self.first = np.searchsorted(self.start, at)
        if hashes:
            p, q = _powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE_KEYS[self.data] * p[: len(raw)], out=total[1:])
            h = (total[self.end] - total[self.start]) * q[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hashes for single words, already lower-cased."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        b = np.frombuffer(w, np.uint8)
        p, _ = _powers(len(b) + 1)
        out[i] = (_BYTE_KEYS[b] * p[: len(b)]).sum(dtype=np.uint64) + np.uint64(len(b))
    return mix(out)


def lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in sorted ``keys``, -1 where missing."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    i = np.searchsorted(keys, values)
    i[i == len(keys)] = 0
    return np.where(keys[i] == values, i, -1)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``counts`` steps, one run after another."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def strings(words: pa.Array) -> list[str]:
    """Python strings of words without spaces, many times faster than one by one."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")
