"""Who may see what, typed predicates, and the graph walk over tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("language", "product", "status", "region", "kind")


@dataclass(frozen=True)
class Principal:
    tenant: str
    roles: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.tenant or not self.roles or not all(isinstance(r, str) and r for r in self.roles):
            raise ValueError("a principal has a tenant and roles")


def instant(value: Column) -> Column:
    """A timestamp with a zone, in UTC; null for one without."""
    return F.when(value.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(value))


def authorized(principal: Principal, valid: Column, allowed: Column, tenant: Column, roles: Column) -> Column:
    """Deny unless everything says yes."""
    ok = valid & allowed & (tenant == principal.tenant) & F.arrays_overlap(roles, F.array(*map(F.lit, principal.roles)))
    return F.coalesce(ok, F.lit(False))


def predicate(exact: dict[str, object], field: str | None = None, low=None, high=None, fields: tuple[str, ...] = FIELDS) -> Column:
    """Equality on known fields and one half-open range; null never matches."""
    if unknown := set(exact) - set(fields):
        raise ValueError(f"no field {sorted(unknown)}")
    if any(v is None for v in exact.values()):
        raise ValueError("null is no value to ask for")
    if field is not None and (low is None or high is None or not low < high):
        raise ValueError("a range is half-open and not empty")
    out = F.lit(True)
    for name, value in exact.items():
        out = out & F.col(name).isNotNull() & (F.col(name) == value)
    if field is not None:
        out = out & (F.col(field) >= low) & (F.col(field) < high)
    return F.coalesce(out, F.lit(False))


def reachable(edges: DataFrame, starts: DataFrame, banned: DataFrame | None = None, hops: int = 8) -> DataFrame:
    """(node, hop) by breadth-first joins; banned nodes are not passed."""
    seen = starts.select("node", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        if banned is not None:
            step = step.join(banned.select("node"), "node", "left_anti")
        front = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen
