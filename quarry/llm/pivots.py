"""Links among fingerprints, found with tables of their distances to pivots."""

from __future__ import annotations

import numpy as np

from quarry.llm.kernels import mix

PIVOTS = 16
#: Reference fingerprints, from a rule.
REFERENCES = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Runs of up to so many rows are searched side by side, with so many pivots each.
SIDE, SIDE_PIVOTS = 512, 4


def distance(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differing bits of words, or of rows of words along the last axis of two and more axes."""
    bits = np.bitwise_count(one ^ two)
    return bits.sum(axis=-1, dtype=np.int16) if bits.ndim > 1 else bits.astype(np.int16)


def linked(values: np.ndarray, bits: int, references: np.ndarray = REFERENCES) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints (of a word, or a row of words each), as pairs of places."""
    values, references = (x.reshape(len(x), -1) for x in (values, references))
    table = np.stack([distance(values, r[None]) for r in references], axis=1)
    order = np.argsort(table[:, 0], kind="stable")
    table, values = table[order], values[order]
    rest = np.arange(len(values))
    out = []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            lo = np.searchsorted(table[rest, 0], table[x, 0] - bits, side="left")
            hi = np.searchsorted(table[rest, 0], table[x, 0] + bits, side="right")
            near = rest[lo:hi]
            near = near[np.abs(table[near, 1:] - table[x, 1:]).max(axis=1) <= bits] if len(near) else near
            near = near[distance(values[near], values[x][None]) <= bits]
            if len(near):
                out += [(int(order[x]), int(order[y])) for y in near]
                rest = rest[~np.isin(rest, near, assume_unique=True)]
                front += near.tolist()
    return out


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each of n places the smallest that links lead to."""
    label = np.arange(n)
    while (label[src] != label[dst]).any():
        one, two = label[src], label[dst]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]
    return label


def clusters(keys: np.ndarray, values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each row the first of those that links within its run of equal keys lead to.

    bits: how many may differ, the same for all rows of a run.  A run's own rows are its pivots: where near copies are many, most rows are near to one
    and all others are discarded by it.
    """
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(cut)
    start, size = np.repeat(cut[:-1], sizes), np.repeat(sizes, sizes)
    tables = [distance(values, values[start + size * k // SIDE_PIVOTS]) for k in range(SIDE_PIVOTS)]
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, step = np.flatnonzero((size > 1) & (size <= SIDE)), 1
    end = start + size
    while len(live := live[live + step < end[live]]):
        near = live
        for t in tables:
            near = near[np.abs(t[near] - t[near + step]) <= bits[near]]
        near = near[distance(values[near], values[near + step]) <= bits[near]]
        src.append(near)
        dst.append(near + step)
        step += 1
    for a, b in ((a, a + n) for a, n in zip(cut[:-1].tolist(), sizes.tolist()) if n > SIDE):
        pairs = np.array(linked(values[a:b], int(bits[a]), values[a + (b - a) * np.arange(PIVOTS) // PIVOTS]), np.int64).reshape(-1, 2) + a
        src.append(pairs[:, 0])
        dst.append(pairs[:, 1])
    return components(len(keys), np.concatenate(src), np.concatenate(dst))
