"""Training mathematics: matrix products, contrastive gradients, low-rank query adapters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, col, a) times (col, x): (row, y), with an exchange of partial sums only."""
    return matrix.join(vector, "col").groupBy("row").agg(F.sum(F.col("a") * F.col("x")).alias("y"))


def contrastive_gradient(matrix: np.ndarray, query: np.ndarray, passages: np.ndarray, positive: int, temperature: float = 1.0, normalize: bool = False) -> tuple[float, np.ndarray]:
    """Loss of one positive among passages and its gradient by the projection of the query.

    With y = M q (scaled to length one if asked) the loss is -log softmax(P y / t)[positive].
    """
    if temperature <= 0 or not 0 <= positive < len(passages):
        raise ValueError("a temperature over zero and a positive among the passages are needed")
    y = matrix @ query
    length = float(np.sqrt(y @ y))
    if normalize and not length:
        raise ValueError("a zero vector has no direction")
    u = y / length if normalize else y
    z = passages @ u / temperature
    top = z.max()
    p = np.exp(z - top)
    loss = float(np.log(p.sum()) + top - z[positive])
    p /= p.sum()
    p[positive] -= 1
    by_u = passages.T @ p / temperature
    by_y = (by_u - u * (u @ by_u)) / length if normalize else by_u
    return loss, np.outer(by_y, query)


def finite_differences(matrix: np.ndarray, *args, step: float = 1e-6, **kwargs) -> np.ndarray:
    """The same gradient by central differences, to check the other."""
    out = np.zeros_like(matrix, dtype=float)
    for at in np.ndindex(*matrix.shape):
        moved = np.zeros_like(out)
        moved[at] = step
        out[at] = (contrastive_gradient(matrix + moved, *args, **kwargs)[0] - contrastive_gradient(matrix - moved, *args, **kwargs)[0]) / (2 * step)
    return out


def adapted(v: Column, a: list[list[float]], b: list[list[float]]) -> Column:
    """unit(v + B (A v)) as an expression; A has the rank's rows, B the dimension's."""
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  a value that is worked out once
    times = lambda rows, x: F.transform(F.lit(rows), lambda r: F.aggregate(F.zip_with(r, x, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y))
    moved = once(times(a, v), lambda low: F.zip_with(v, times(b, low), lambda x, y: x + y))

    def scaled(m: Column) -> Column:
        return once(F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n > 0, F.transform(m, lambda x: x / n)))

    return once(moved, scaled)


def train_adapter(queries: np.ndarray, passages: np.ndarray, positive: np.ndarray, rank: int = 2, steps: int = 200, rate: float = 0.01, temperature: float = 0.1, held: tuple | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Low-rank A, B by Adam on in-batch losses; the step with the least held-out loss is kept.

    queries (n, d), passages (m, d) and each query's positive: a bounded sample, held by the driver.
    """
    rng = np.random.default_rng(seed)
    d = queries.shape[1]
    a, b = rng.normal(scale=1 / math.sqrt(d), size=(rank, d)), np.zeros((d, rank))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (a, b)]

    def loss(a: np.ndarray, b: np.ndarray, q: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        y = q + q @ a.T @ b.T
        length = np.sqrt((y * y).sum(axis=1, keepdims=True))
        u = y / length
        z = u @ passages.T / temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        value = float(-np.log(p[np.arange(len(q)), at]).mean())
        p[np.arange(len(q)), at] -= 1
        by_u = p @ passages / temperature / len(q)
        by_y = (by_u - u * (u * by_u).sum(axis=1, keepdims=True)) / length
        return value, (by_y @ b).T @ q, by_y.T @ (q @ a.T)

    check = held or (queries, positive)
    best = (loss(a, b, *check)[0], a.copy(), b.copy())
    for t in range(1, steps + 1):
        _, ga, gb = loss(a, b, queries, positive)
        for x, g, (m, v) in zip((a, b), (ga, gb), state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        now = loss(a, b, *check)[0]
        if now < best[0]:
            best = (now, a.copy(), b.copy())
    return best[1], best[2], best[0]


def group_scores(ranked: DataFrame, positive: DataFrame, k: int) -> DataFrame:
    """(hit, rr, n) of ranked (query_id, item, rank) against one positive (query_id, item) each."""
    at = positive.join(ranked.filter(F.col("rank") <= k), ["query_id", "item"], "left")
    return at.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("hit"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("rr"), F.count("*").alias("n"))
