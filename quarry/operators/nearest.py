"""The k best rows of many queries, exactly: a matrix product for each pair of blocks.

Rows and queries are packed into blocks of vectors.  Every block of queries meets every
block of rows in some task (a Cartesian product of a few hundred blocks, not of rows); the
task holds k rows for each of its queries and nothing else.  Products in single precision,
less a bound of their error, tell which pairs may count; these are scored again in double
precision, component by component in order, as the Columns of ``functions.vectors`` do.

Order: NaN first, then by the score rounded to nine places, null scores last; ties to the
smaller item.  A vector that is null, holds a null or has another dimension scores null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block.
ROWS, QUERIES, FEW_QUERIES = 8192, 4096, 256
#: Scores that are looked at together.
TILE = 1 << 20
#: Larger components are compared without single precision.
WIDE = 1e15
REGULAR, WILD, BLANK = 0, 1, 2
NULL_ID = -(1 << 63)
BLOCK = "uid long, kind int, dim int, width int, ids binary, vectors binary, more binary, has binary, tags binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def rounded(x: np.ndarray) -> np.ndarray:
    """Nine places, halves away from zero, by the shortest decimal of each value, as Spark's round."""
    out = x.copy()
    at = np.flatnonzero(np.isfinite(x))
    y = np.abs(x[at]) * 1e9
    whole = np.floor(y)
    hard = (np.abs(y - whole - 0.5) <= 1e-4 + y * 1e-15) | (y > 1e15)
    out[at] = np.copysign((whole + (y - whole > 0.5)) / 1e9, x[at])
    for i in at[hard]:
        d = Decimal(repr(float(x[i])))
        out[i] = float(d.quantize(Decimal("1e-9"), ROUND_HALF_UP)) if abs(d) < 10**15 else x[i]
    return out


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of a's vectors with b's, pair by pair; sums run in the order of the components."""
    terms = a * b if metric == "dot" else np.abs(a - b) if metric == "l1" else (a - b) * (a - b)
    total = np.cumsum(terms, axis=-1)[..., -1] if terms.shape[-1] else np.zeros(terms.shape[:-1])
    return total if metric == "dot" else -np.sqrt(total) if metric == "l2" else -total


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists: which are there, their lengths and starts, all values with nulls as NaN, and how many nulls came before each."""
    valid = np.asarray(column.is_valid())
    flat = column.flatten()
    size = np.where(valid, np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)), 0).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    nulls = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))])
    return valid, size, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size, values, nulls


def _repeats(*parts: np.ndarray) -> np.ndarray:
    """Of rows in order: how many equal ones came before each."""
    flat = np.ascontiguousarray(np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1) for p in parts], axis=1))
    flat = np.pad(flat, ((0, 0), (0, -flat.shape[1] % 8))).view(np.uint64)
    mixed = (flat * (np.arange(1, flat.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(axis=1)
    if len(np.unique(mixed)) == len(mixed):
        return np.zeros(len(mixed), np.int64)
    _, group = np.unique(flat, axis=0, return_inverse=True)
    group = group.reshape(-1)
    order = np.argsort(group, kind="stable")
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    return out


def packed(rows: DataFrame, most: int, copies: int | None, none: int) -> DataFrame:
    """Blocks of rows (id, v, and more and tags if there): vectors of one dimension, in the order of ids.

    Of equal vectors in a block only the first ``copies`` can be among the best of a query.
    Null tags become ``none``, which must not be a tag of the other side.
    """
    extra, tagged = "more" in rows.columns, "tags" in rows.columns

    def block(uid: int, kind: int, dim: int, parts: list) -> list:
        ids, x, more, has = (np.concatenate([p[i] for p in parts]) for i in range(4))
        width = max(p[4].shape[1] for p in parts)
        tags = np.concatenate([np.pad(p[4], ((0, 0), (0, width - p[4].shape[1])), constant_values=none) for p in parts])
        order = np.argsort(ids, kind="stable")
        ids, x, more, has, tags = ids[order], x[order], more[order], has[order], tags[order]
        if copies is not None and kind == REGULAR and len(ids) > 1:
            kept = _repeats(x, more, has, tags) < copies if dim or extra or tagged else np.arange(len(ids)) < copies
            ids, x, more, has, tags = ids[kept], x[kept], more[kept], has[kept], tags[kept]
        return [uid, kind, dim, width, ids.tobytes(), x.tobytes(), more.tobytes(), has.tobytes(), tags.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made, task = {}, 0, TaskContext.get().partitionId()

        def give(key: tuple, parts: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) if i == 0 else pa.array([x], pa.int32()) if i < 4 else pa.array([x], pa.binary()) for i, x in enumerate(block(task << 32 | made, *key, parts))], names=NAMES)

        for b in batches:
            ids = b["id"].fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            valid, size, start, values, nulls = _lists(b["v"])
            odd = np.concatenate([[0], np.cumsum(~(np.abs(values) <= WIDE))])
            kind = np.where(~valid | (nulls[start + size] > nulls[start]), BLANK, np.where(odd[start + size] > odd[start], WILD, REGULAR))
            dim = np.where(kind == BLANK, 0, size)
            if tagged:
                t_valid, t_size, t_start, t_values, _ = _lists(b["tags"])
                width = int(t_size.max(initial=0))
                place = np.arange(width)
                at = np.minimum(t_start[:, None] + place, max(len(t_values) - 1, 0))
                tags = np.where(place < t_size[:, None], np.nan_to_num(t_values[at], nan=none) if len(t_values) else none, none).astype(np.int32)
            else:
                tags = np.zeros((len(ids), 0), np.int32)
            if extra:
                m_valid, m_size, m_start, m_values, m_nulls = _lists(b["more"])
            for key in sorted(set(zip(kind.tolist(), dim.tolist()))):
                at = np.flatnonzero((kind == key[0]) & (dim == key[1]))
                x = values[start[at][:, None] + np.arange(key[1])]
                has, more = np.ones(len(at), bool), np.zeros((len(at), 0))
                if extra:
                    has = m_valid[at] & (m_size[at] == key[1]) & (m_nulls[m_start[at] + m_size[at]] == m_nulls[m_start[at]])
                    more = np.zeros((len(at), key[1]))
                    more[has] = m_values[m_start[at][has][:, None] + np.arange(key[1])]
                for i in range(0, len(at), most):
                    s = slice(i, i + most)
                    parts = held.setdefault(key, [])
                    if parts and sum(len(p[0]) for p in parts) + len(at[s]) > most:
                        yield give(key, held.pop(key))
                        parts = held.setdefault(key, [])
                    parts.append((ids[at[s]], x[s], more[s], has[s], tags[at[s]]))
        for key, parts in held.items():
            yield give(key, parts)

    return rows.mapInArrow(run, BLOCK)


class Block:
    """A block as it comes out of a row."""

    def __init__(self, uid: int, kind: int, dim: int, width: int, ids, vectors, more, has, tags):
        self.uid, self.kind, self.dim = uid, kind, dim
        self.ids = np.frombuffer(ids, np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(vectors, np.float64).reshape(n, dim) if kind != BLANK else None
        self.more = np.frombuffer(more, np.float64).reshape(n, -1) if n and len(more) else None
        self.has = np.frombuffer(has, bool)
        self.tags = np.frombuffer(tags, np.int32).reshape(n, width)
        if kind == REGULAR:
            self.single = self.x.astype(np.float32)
            self.square = (self.x * self.x).sum(axis=1)
            self.size = np.sqrt(self.square)
            self.one = np.abs(self.x).sum(axis=1)


class Best:
    """The k best so far of each query of a block."""

    def __init__(self, query: Block, k: int):
        n = len(query.ids)
        self.query, self.k = query, k
        self.n = np.zeros(n, np.int64)
        self.rank = np.zeros((n, k), np.int8)  # 2: NaN, 1: a number, 0: null
        self.key, self.item, self.score, self.other, self.there = np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k), bool)
        self.held: list[tuple] = []
        self.waiting = 0

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each query what a row has to reach: rank (-1 while there is room) and key."""
        full = self.n == self.k
        return np.where(full, self.rank[:, -1], -1), self.key[:, -1]

    def add(self, q, rank, key, item, score, other, there) -> None:
        self.held.append((q, rank, key, item, score, other, there))
        self.waiting += len(q)
        if self.waiting >= max(len(self.n) * self.k, 1 << 16):
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        q = [x[0] for x in self.held]
        touched = np.unique(np.concatenate(q))
        old = np.arange(self.k) < self.n[touched][:, None]
        kept = [np.broadcast_to(touched[:, None], old.shape)[old], *(getattr(self, c)[touched][old] for c in ("rank", "key", "item", "score", "other", "there"))]
        q, rank, key, item, score, other, there = (np.concatenate([a, *(x[i] for x in self.held)]) for i, a in enumerate(kept))
        self.held, self.waiting = [], 0
        order = np.lexsort((item, -key, -rank, q))
        q = q[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        on = place < self.k
        order, q, place = order[on], q[on], place[on]
        for c, x in (("rank", rank), ("key", key), ("item", item), ("score", score), ("other", other), ("there", there)):
            getattr(self, c)[q, place] = x[order]
        self.n[touched] = np.minimum(np.bincount(q, minlength=len(self.n))[touched], self.k)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and b have a tag in common at one place; of a single tag in b, at any place."""
    out = np.zeros((len(a), len(b)), bool)
    for t in range(a.shape[1]):
        other = b[:, min(t, b.shape[1] - 1)] if b.shape[1] else np.zeros(len(b), np.int32)
        out |= a[:, t][:, None] == other[None, :]
    return out


def _narrow(block: Block) -> np.ndarray:
    t = block.tags
    return t.astype(np.int8) if t.size and t.min() >= -128 and t.max() < 128 else t


class Pair:
    """Scores of a block of queries with a block of rows."""

    def __init__(self, metric: str, tagged: bool, together: bool):
        self.metric, self.tagged, self.together = metric, tagged, together

    def allowed(self, query: Block, rows: Block, s: slice) -> np.ndarray | None:
        out = None
        if self.tagged:
            a, b = _narrow(query), _narrow(rows)
            out = _shared(a[s], b)
        if self.together:
            common = (query.x[s] != 0).astype(np.float32) @ (rows.x != 0).astype(np.float32).T > 0
            out = common if out is None else out & common
        return out

    def approximate(self, query: Block, rows: Block, s: slice) -> np.ndarray:
        if self.metric == "l1":
            a, b = query.single[s], np.ascontiguousarray(rows.single.T)
            out, gap = np.zeros((len(a), b.shape[1]), np.float32), np.empty((len(a), b.shape[1]), np.float32)
            for d in range(query.dim):
                np.subtract(a[:, d, None], b[d], out=gap)
                np.abs(gap, out=gap)
                out -= gap
            return out
        out = query.single[s] @ rows.single.T
        if self.metric != "dot":
            out -= (rows.square / 2).astype(np.float32)
        return out

    def error(self, query: Block, rows: Block) -> np.ndarray:
        unit = 4 * (query.dim + 4) * 2.0**-24
        if self.metric == "l1":
            return unit * (query.one + rows.one.max()) + 1e-30
        far = rows.size.max()
        return unit * (query.size * far + (0 if self.metric == "dot" else far * far)) + 1e-30

    def floor(self, score: np.ndarray, square: np.ndarray, error: np.ndarray) -> np.ndarray:
        """What an approximate score has to reach, if the exact one is to reach ``score`` when both are rounded."""
        least = score - 2e-9
        if self.metric in ("sql2", "l2"):
            least = (square + (least if self.metric == "sql2" else -np.square(np.minimum(least, 0)))) / 2
        return least - error - np.abs(least) * 1e-6

    def meets(self, approximate: np.ndarray, square: np.ndarray, error: np.ndarray) -> np.ndarray:
        """The exact score that an approximate one stands for at least."""
        low = approximate - error - np.abs(approximate) * 1e-6
        if self.metric in ("sql2", "l2"):
            low = 2 * low - square
            return low if self.metric == "sql2" else -np.sqrt(np.maximum(-low, 0))
        return low

    def search(self, best: Best, rows: Block) -> None:
        query, k = best.query, best.k
        if not len(rows.ids) or not len(query.ids):
            return
        nothing = BLANK in (query.kind, rows.kind) or query.dim != rows.dim
        if nothing and (self.together or not self.tagged and (best.least()[0] > 0).all()):
            return
        if nothing or WILD in (query.kind, rows.kind):
            return self.plain(best, rows, nothing)
        error = self.error(query, rows)
        n, step = len(rows.ids), max(1, TILE // len(rows.ids))
        for i in range(0, len(query.ids), step):
            s = slice(i, i + step)
            near = self.approximate(query, rows, s)
            allowed = self.allowed(query, rows, s)
            if allowed is not None:
                near[~allowed] = -np.inf
            rank, key = (x[s] for x in best.least())
            square = query.square[s]
            need = np.where(rank > 1, np.inf, np.where(rank == 1, self.floor(key, square, error[s]), -np.inf))
            on = near >= need[:, None].astype(np.float32)
            if n > k and on.sum() > 2 * k * len(on):
                kth = np.partition(near, n - k, axis=1)[:, n - k].astype(np.float64)
                some = np.isfinite(kth)
                need[some] = np.maximum(need[some], self.floor(self.meets(kth, square, error[s]), square, error[s])[some])
                on = near >= need[:, None].astype(np.float32)
            if allowed is not None:
                on &= allowed
            q, r = np.nonzero(on)
            for j in range(0, len(q), 1 << 14):
                a, b = q[j : j + (1 << 14)] + i, r[j : j + (1 << 14)]
                self.enter(best, rows, a, b, exact(query.x[a], rows.x[b], self.metric), False)

    def plain(self, best: Best, rows: Block, nothing: bool) -> None:
        """Pairs that single precision is not fit for, or that have no score."""
        query = best.query
        n = min(len(rows.ids), best.k) if nothing and not self.tagged else len(rows.ids)
        step = max(1, TILE // 8 // max(n * max(query.dim, 1), 1))
        for i in range(0, len(query.ids), step):
            s = slice(i, i + step)
            allowed = self.allowed(query, rows, s)
            q, r = np.nonzero(np.ones((len(query.ids[s]), n), bool) if allowed is None else allowed)
            for j in range(0, len(q), 1 << 14):
                a, b = q[j : j + (1 << 14)] + i, r[j : j + (1 << 14)]
                with np.errstate(all="ignore"):
                    score = np.zeros(len(a)) if nothing else exact(query.x[a], rows.x[b], self.metric)
                self.enter(best, rows, a, b, score, nothing)

    def enter(self, best: Best, rows: Block, a: np.ndarray, b: np.ndarray, score: np.ndarray, nothing: bool) -> None:
        rank = np.full(len(a), 0 if nothing else 1, np.int8)
        rank[np.isnan(score)] = 2
        key = rounded(np.where(rank == 2, 0.0, score))
        low, least = (x[a] for x in best.least())
        on = (rank > low) | (rank == low) & (key >= least)
        a, b, rank, key, score = a[on], b[on], rank[on], key[on], score[on]
        other, there = np.zeros(len(a)), np.zeros(len(a), bool)
        if rows.more is not None and len(a) and best.query.kind != BLANK and best.query.dim == rows.dim:
            there = rows.has[b]
            with np.errstate(all="ignore"):
                other = np.where(there, exact(best.query.x[a], rows.more[b], self.metric), 0.0)
        best.add(a, rank, key, rows.ids[b], score, other, there)


def _ids(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def crossed(rows: DataFrame, queries: DataFrame, copies: int | None) -> DataFrame:
    """Every block of rows (item, v[, more][, tags]) beside every block of queries (query_id, v[, tags]).

    Blocks of queries are as many as keep all cores busy, larger ones where there are many
    queries; rows are dealt in few parts, so that a query's best rows come from few tasks.
    """
    spark = rows.sparkSession
    slots, asked = spark.sparkContext.defaultParallelism, queries.count()
    block = min(QUERIES, max(FEW_QUERIES, -(-asked // (2 * slots))))
    parts = max(1, -(-asked // block))
    name = lambda df, i: df.select(F.col(i).cast("long").alias("id"), "v", *(c for c in ("more", "tags") if c in df.columns))
    q = packed(name(queries, "query_id").repartition(parts), 2 * block, None, -2)
    q = q.withColumn("at", F.shiftright("uid", 32).cast("int")).repartitionById(parts, "at").drop("at")
    i = packed(name(rows, "item"), ROWS, copies, -1).repartition(max(1, -(-2 * slots // parts)))
    both = i.select(*(F.col(c).alias(f"i_{c}") for c in NAMES)).hint("shuffle_replicate_nl")
    return both.crossJoin(q.select(*(F.col(c).alias(f"q_{c}") for c in NAMES)).hint("shuffle_replicate_nl"))


def column(values: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.array(values, mask=none, from_pandas=False)


def blocks(batch: pa.RecordBatch, side: str, i: int) -> Block:
    row = [batch[f"{side}_{c}"][i] for c in NAMES]
    return Block(*(x.as_py() for x in row[:4]), *(x.as_buffer() for x in row[4:]))


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "dot", together: bool = False) -> DataFrame:
    """(query_id, item, score[, other]): for each query at least its k best of rows (item, v), and few more.

    With tags (array<int>, none negative) on both sides only pairs count that have one in common, at the same
    place; where rows have one tag, at any place of the query's.  With ``together`` only pairs
    count that are both not zero in some component.  If rows have ``more``, a second vector,
    ``other`` is the score with it.  metric: dot, l1, l2 (negative distances) or sql2 (squared).
    """
    if metric not in ("dot", "l1", "l2", "sql2"):
        raise ValueError(f"no metric {metric}")
    extra, tagged = "more" in rows.columns, "tags" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, found, last = Pair(metric, tagged, together), {}, None
        for b in batches:
            for i in range(b.num_rows):
                uid = b["q_uid"][i].as_py()
                if uid not in found:
                    found[uid] = Best(blocks(b, "q", i), k)
                if last is None or last.uid != b["i_uid"][i].as_py():
                    last = blocks(b, "i", i)
                pair.search(found[uid], last)
        for best in found.values():
            best.merge()
            on = np.arange(k) < best.n[:, None]
            q, item, score, none, other, there = (x[on] for x in (np.broadcast_to(best.query.ids[:, None], on.shape), best.item, best.score, best.rank == 0, best.other, best.there))
            for j in range(0, len(q), 1 << 16):
                s = slice(j, j + (1 << 16))
                out = [column(q[s], q[s] == NULL_ID), column(item[s], item[s] == NULL_ID), column(score[s], none[s]), column(other[s], ~there[s])]
                yield pa.RecordBatch.from_arrays(out[: 4 if extra else 3], names=["query_id", "item", "score", "other"][: 4 if extra else 3])

    found = crossed(rows, queries, k).mapInArrow(run, "query_id long, item long, score double" + (", other double" if extra else ""))
    kinds = {"query_id": queries.schema["query_id"].dataType, "item": rows.schema["item"].dataType}
    return found.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})


def integral(rows: DataFrame, queries: DataFrame) -> bool:
    return _ids(rows, "item") and _ids(queries, "query_id")
