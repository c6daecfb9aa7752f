"""Vector arithmetic as Columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def fold2(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return fold2(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column) -> Column:
    return fold2(a, b, lambda x, y: (x - y) * (x - y))


def l1(a: Column, b: Column) -> Column:
    return fold2(a, b, lambda x, y: F.abs(x - y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Division by a zero norm is an error, as a zero vector has no direction."""
    once = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / n))  # the norm once a vector, not once a component
    return F.get(once, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def checked(v: Column, dimension: int | None = None) -> Column:
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ok if dimension is None else ok & (F.size(v) == dimension)


def measure(a: Column, b: Column, metric: str) -> Column:
    """Larger is nearer for every metric."""
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine":
        return cosine(a, b)
    if metric == "l2":
        return -F.sqrt(squared_l2(a, b))
    if metric == "l1":
        return -l1(a, b)
    raise ValueError(f"no metric {metric}")


def box_bound(low: Column, v: Column, high: Column) -> Column:
    """Smallest squared distance from a vector to a box."""
    gap = F.zip_with(F.zip_with(low, v, lambda a, x: F.greatest(a - x, F.lit(0.0))), F.zip_with(v, high, lambda x, b: F.greatest(x - b, F.lit(0.0))), lambda a, b: F.greatest(a, b))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def plane(table: int, bit: int, dimension: int) -> list[float]:
    """A hyperplane from a rule that any engine can rebuild: values in -1 to 1."""
    return [((table * 7919 + bit * 104729 + d * 1299709 + 17) * 48271 % 2147483647) % 2001 / 1000.0 - 1.0 for d in range(dimension)]


def signature(v: Column, table: int, bits: int, dimension: int) -> Column:
    """A bit per hyperplane, 1 where the product is not negative."""
    out = F.lit(0)
    for b in range(bits):
        out = out * 2 + (dot(v, F.lit(plane(table, b, dimension))) >= 0).cast("int")
    return out
