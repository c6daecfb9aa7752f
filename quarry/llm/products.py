"""Exact largest inner products by norm-bucketed retrieval.

Candidates of a batch are sorted by length and cut into buckets of similar length.  For
a query q with the k-th score so far theta, a bucket whose longest vector has length m
needs a cosine of at least theta / (|q| m): over one, the bucket and all shorter ones are
pruned; high ones use coordinate pruning (a feasible range for the query's strongest
coordinates); low ones use length pruning.  Survivors are verified by exact products.
Thresholds start from the longest candidates, which are searched first.

Queries go out in blocks of bounded size, each against all rows; a task keeps k rows a
query.  Products of integers stay exact in double precision below 2**53; beyond it
Python's integers are used.

Defined results: a vector that is null or has a null or non-finite component takes no
part; vectors of other lengths count as if zeros followed; repeated vec_ids among
queries count once (the first by vector), rows with the query's own id are no
candidates; fewer candidates than k give fewer rows; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SCALE = 1024
TOP = 10
BLOCK_QUERIES = 4096
BUCKET = 512
SEEDS = 2048
#: From this cosine on, coordinates prune better than lengths.
COORDINATE_FROM = 0.6
FOCUS = 4


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, matrix of floor(SCALE * x)) of a column of float lists."""
    rows, vectors = [], []
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    if not flat.null_count and not column.null_count and len(sizes) and (sizes == sizes[0]).all() and sizes[0]:
        m = np.asarray(flat, dtype=np.float64).reshape(len(sizes), -1)
        keep = np.flatnonzero(np.isfinite(m).all(axis=1))
        return keep, np.floor(m[keep] * SCALE)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append(i)
            vectors.append(v)
    wide = max(map(len, vectors), default=0)
    m = np.zeros((len(rows), wide))
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return np.array(rows, np.int64), np.floor(m * SCALE)


def _wide(m: np.ndarray, n: int) -> np.ndarray:
    return m if m.shape[1] >= n else np.hstack([m, np.zeros((len(m), n - m.shape[1]))])


class Search:
    """The best k candidates so far for each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors**2).sum(axis=1))
        self.theta = np.full(len(ids), -np.inf)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)
        unit = vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        self.unit = unit

    def _take(self, q: int, scores: list[int], ids: list[int]) -> None:
        own = int(self.ids[q])
        best = self.best[q] + [(-s, i) for s, i in zip(scores, ids) if i != own]
        best.sort()
        self.best[q] = best[: self.k]
        if len(self.best[q]) == self.k:
            self.theta[q] = -self.best[q][-1][0]

    def _products(self, qs: np.ndarray, m: np.ndarray, longest: float) -> np.ndarray:
        a = self.vectors[qs]
        if len(qs) and longest * float(self.norm[qs].max()) >= 2.0**52:
            to = np.vectorize(int, otypes=[object])
            return to(a) @ to(m.T) if a.size and m.size else np.zeros((len(a), len(m)))
        return a @ m.T

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        wide = max(m.shape[1], self.vectors.shape[1])
        m = _wide(m, wide)
        if self.vectors.shape[1] < wide:
            self.vectors, self.unit = _wide(self.vectors, wide), _wide(self.unit, wide)
        norm = np.sqrt((m**2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        ids, m, norm = ids[order], m[order], norm[order]
        live = np.arange(len(self.ids))
        for a in range(0, len(ids), BUCKET):
            part, length, names = m[a : a + BUCKET], norm[a : a + BUCKET], ids[a : a + BUCKET]
            longest = float(length[0])
            with np.errstate(divide="ignore", invalid="ignore"):
                bound = self.norm[live] * longest * (1 + 1e-12)
                live = live[~(bound < self.theta[live])]  # shorter buckets reach less still
                cosine = np.nan_to_num(self.theta[live] / (self.norm[live] * longest), nan=-np.inf, neginf=-np.inf)
            by_length = live[~((cosine >= COORDINATE_FROM) & (longest > 0))]
            if len(by_length):
                # length pruning: rows are sorted, so a query needs a prefix of the bucket
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.nan_to_num(self.theta[by_length] / self.norm[by_length], nan=-np.inf, neginf=-np.inf)
                rows = int(np.searchsorted(-length, -float(need.min()) * (1 - 1e-12) if need.min() > 0 else np.inf, side="right"))
                score = self._products(by_length, part[:rows], longest)
                self._best_of(by_length, score, names[:rows])
            unit = None
            for q, t in zip(live, cosine):
                if not (t >= COORDINATE_FROM and longest > 0):
                    continue
                if unit is None:
                    unit = part / np.maximum(length, 1e-300)[:, None]
                t = min(float(t), 1.0)
                near = np.ones(len(part), bool)
                for f in self.focus[q]:
                    x = float(self.unit[q, f])
                    around = math.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))
                    low, high = t * x - around, t * x + around
                    # a cosine over t is allowed as well: the range ends at +-1 beyond x
                    if x >= t:
                        high = 1.0
                    if -x >= t:
                        low = -1.0
                    near &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
                near = np.flatnonzero(near)
                if len(near):
                    self._best_of(np.array([q]), self._products(np.array([q]), part[near], longest), names[near])

    def _best_of(self, qs: np.ndarray, score: np.ndarray, names: np.ndarray) -> None:
        for row in np.flatnonzero((score >= self.theta[qs, None]).any(axis=1)):
            q, s = int(qs[row]), score[row]
            hit = np.flatnonzero(s >= self.theta[q])
            if len(hit) > 4 * self.k and s.dtype != object:
                # of equal scores the smallest ids; one more than k, as the query itself may be there
                hit = hit[np.lexsort((names[hit], -s[hit]))[: self.k + self._own(q, names[hit])]]
            self._take(q, [int(x) for x in s[hit]], names[hit].tolist())

    def _own(self, q: int, names: np.ndarray) -> int:
        return int((names == self.ids[q]).sum())


def top_products(vectors: DataFrame, is_query, k: int = TOP, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    seeds = [(r["vec_id"], r["embedding"]) for r in valid.orderBy(F.desc(length), "vec_id", "embedding").limit(SEEDS).collect()]
    seed_ids = np.array([i for i, _ in seeds], np.int64)
    _, seed_rows = integers(pa.array([v for _, v in seeds], pa.list_(pa.float64())))

    def blocks() -> Iterator[list]:
        held: list = []
        for r in valid.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toLocalIterator():
            held.append((r["vec_id"], r["embedding"]))
            if len(held) == block:
                yield held
                held = []
        if held:
            yield held

    def searched(queries: list) -> DataFrame:
        ids = np.array([i for i, _ in queries], np.int64)
        _, m = integers(pa.array([v for _, v in queries], pa.list_(pa.float64())))
        first = Search(ids, m, k)
        first.add(seed_ids, seed_rows)
        sent = spark.sparkContext.broadcast((ids, m, first.theta))
        if getattr(sent, "_path", None):
            sent.__dict__.pop("_value", None)  # the driver holds one block at a time

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q_rows, theta = sent.value
            search = Search(q_ids, q_rows, k)
            # a bound that k candidates reach already, so rows below it never matter
            search.theta = theta.copy()
            for b in batches:
                keep, rows_ = integers(b["embedding"])
                search.add(np.asarray(b["vec_id"])[keep], rows_)
            found = [(int(q_ids[q]), i, -s) for q, best in enumerate(search.best) for s, i in best]
            a, b_, c = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64()), pa.array(c, pa.int64())], names=["query_id", "vec_id", "score"])

        return valid.mapInArrow(run, "query_id long, vec_id long, score long")

    out = None
    for queries in blocks():
        part = searched(queries)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
