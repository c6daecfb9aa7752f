"""Made-up inputs: larger corpora, keys to look up, vectors with planted neighbours, fixtures; lookups timed."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cloned(docs: DataFrame, copies: int, key: str = "doc_id") -> DataFrame:
    """The documents so many times, with new ids: copy c of id i is i + c (largest id + 1)."""
    top = docs.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("_step"))
    rows = docs.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).crossJoin(F.broadcast(top))  # one row
    return rows.withColumn(key, F.col(key) + F.col("_copy") * F.col("_step")).drop("_copy", "_step")


def records(spark: SparkSession, n: int) -> DataFrame:
    """(key, value): S00000, S00001, ..."""
    return spark.range(n).select(F.format_string("S%05d", "id").alias("key"), F.col("id").alias("value"))


def lookups(spark: SparkSession, n: int, asked: int = 256, hits: float = 0.5, seed: int = 0) -> DataFrame:
    """(place, key): so many of the keys there and the rest missing, in an order of their own; the same for a seed."""
    there = round(asked * hits)
    h = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n))
    key = F.when(F.col("id") < there, F.format_string("S%05d", h)).otherwise(F.format_string("M%05d", h))
    return spark.range(asked).select(F.xxhash64("id", F.lit(seed + 1)).alias("place"), key.alias("key"))


def _normal(*parts: Column) -> Column:
    """A normal deviate from a hash of the parts: the same on any cluster."""
    u = lambda salt: (F.pmod(F.xxhash64(*parts, F.lit(salt)), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * math.pi * u(2))


def gaussian(spark: SparkSession, n: int, dimension: int, seed: int = 0) -> DataFrame:
    """(item, v): unit vectors of normal deviates."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda d: _normal(F.col("id"), d, F.lit(seed)))
    rows = spark.range(n).select(F.col("id").alias("item"), raw.alias("x"))
    return rows.select("item", _unit(F.col("x")).alias("v"))


def planted(rows: DataFrame, every: int, noise: float, seed: int = 1) -> DataFrame:
    """(query_id, v, item): each so many-th vector with noise; its own row is the planted neighbour."""
    some = rows.filter(F.col("item") % every == 0)
    moved = F.transform("v", lambda x, i: x + noise * _normal(F.col("item"), i, F.lit(seed)))
    return some.select(F.col("item").alias("query_id"), _unit(moved).alias("v"), "item")


def _unit(x: Column) -> Column:
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    return F.transform(x, lambda y: y / length)


def fixtures(spark: SparkSession) -> dict[str, DataFrame]:
    """Small sources of each kind: pages and notes to parse, typed metadata, an event log, sparse weights."""
    pages = [(1, "html", "<h1>A</h1><p>one <b>two</b></p><table><tr><th>k</th><th>v</th></tr><tr><td>x</td><td>1</td></tr></table>"), (2, "html", "<p hidden>no</p><p>yes</p>"), (3, "markdown", "# A\n\ntext\n\n```\n# no heading\n```\n"), (4, "html", None)]
    meta = [("r1", "t", "o", "e", "p", 1, ["a", "b"], "en", 0.5, "2024-01-01T00:00:00Z", "2024-01-02T00:00:00+01:00"), ("r2", "t", "o", "", "p", 1, ["a"], None, 0.5, "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"), ("r3", "t", "o", "e", "p", 1, ["a", "a"], None, 0.5, "2024-01-01T00:00:00", "2024-01-02T00:00:00Z")]
    events = [(1, 1, "upsert", 0, "one"), (1, 2, "upsert", 10, "two"), (2, 1, "upsert", 0, "x"), (2, 2, "delete", 5, "")]
    sparse = [(1, 0, 1.0), (1, 2, 0.5), (2, 2, 2.0)]
    return {
        "pages": spark.createDataFrame(pages, "id long, kind string, text string"),
        "metadata": spark.createDataFrame(meta, "record_id string, tenant string, owner string, entity string, parent_id string, version int, roles array<string>, language string, confidence double, published_at string, updated_at string").withColumn("schema_version", F.lit("1")).withColumn("policy_version", F.lit("1")),
        "events": spark.createDataFrame(events, "source long, revision long, op string, effective long, payload string"),
        "sparse": spark.createDataFrame(sparse, "item long, term long, weight double"),
    }


def linear_find(rows: DataFrame, key: str) -> DataFrame:
    """All rows of a key by a scan; what the store can skip it skips."""
    return rows.filter(F.col("key") == key)


def hash_find(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(place, key, value) of many keys at once by one join; a missing key has a null value."""
    return keys.join(rows, "key", "left").select("place", "key", "value")


def timed(action: Callable[[], object], trials: int = 7) -> list[float]:
    """Milliseconds of so many runs, ascending."""
    out = []
    for _ in range(trials):
        began = time.perf_counter()
        action()
        out.append((time.perf_counter() - began) * 1000)
    return sorted(out)


def timing_summary(ms: list[float]) -> dict[str, float]:
    """Nearest-rank median and 95th percentile, and how many."""
    at = lambda p: sorted(ms)[max(0, math.ceil(p * len(ms)) - 1)]
    return {"n": len(ms), "p50": at(0.5), "p95": at(0.95)} if ms else {"n": 0}


def lookup_experiment(spark: SparkSession, sizes: tuple[int, ...] = (64, 256), asked: int = 64, trials: int = 3) -> DataFrame:
    """(n, way, hits, p50, p95): the same keys by a scan each and by one join."""
    out = []
    for n in sizes:
        rows, keys = records(spark, n), lookups(spark, n, asked)
        ways = {"join": lambda rows=rows, keys=keys: hash_find(rows, keys).agg(F.count("value")).first()[0], "scan": lambda rows=rows, keys=keys: linear_find(rows, keys.orderBy("place").first()["key"]).count()}
        for way, action in ways.items():
            out.append((n, way, int(action()), *(timing_summary(timed(action, trials))[p] for p in ("p50", "p95"))))
    return spark.createDataFrame(out, "n int, way string, hits long, p50 double, p95 double")
