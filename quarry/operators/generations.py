"""Versioned sources: capsules, generations, restored state, and a result cache that asks again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.lifecycle import as_of, heads

#: What the vectors of a generation are made by; it is part of the generation's identity.
MODES = ("body", "entity-body")


def contract(mode: str, dimension: int, model: str) -> dict[str, str]:
    if mode not in MODES:
        raise ValueError("unknown encoding mode")
    return {"mode": mode, "dimension": str(dimension), "metric": "cosine", "norm": "unit", "model": model}


def capsules(base: DataFrame, updates: DataFrame) -> DataFrame:
    """All versions (source, revision, payload); a version that is there twice is an error."""
    rows = base.select("source", "revision", "payload").unionByName(updates.select("source", "revision", "payload"))
    if not rows.groupBy("source", "revision").count().filter("count > 1").isEmpty():
        raise ValueError("a version is there twice")
    return rows.withColumn("key", F.concat_ws("@", "source", "revision")).withColumn("digest", F.sha2("payload", 256))


def schedule(versions: DataFrame, late_every: int, delay: int) -> DataFrame:
    """Delivery times of versions (source, revision, effective): every so many-th is late by the delay."""
    late = F.pmod(F.col("source") + F.col("revision"), F.lit(late_every)) == 0
    return versions.withColumn("received", F.col("effective") + F.when(late, delay).otherwise(0)).withColumn("late", late)


def materialized(history: DataFrame, versions: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """A generation's rows: every version that is no deletion, with its capsule and unit vector.

    history (source, revision, op, effective, digest), versions as ``capsules`` gives them,
    vectors (key, v).  A capsule or vector that is missing, changed or not a unit is an error.
    """
    rows = history.filter("op != 'delete'").join(versions.select("source", "revision", "key", "payload", F.col("digest").alias("now")), ["source", "revision"], "left")
    rows = rows.join(vectors, "key", "left")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    wrong = F.col("now").isNull() | (F.col("now") != F.col("digest")) | F.col("v").isNull() | (F.size("v") != dimension) | (F.abs(length - 1) > 1e-4)
    if not rows.filter(F.coalesce(wrong, F.lit(True))).isEmpty():
        raise ValueError("a capsule or a vector contradicts the history")
    return rows.drop("now")


def state_payload(history: DataFrame) -> DataFrame:
    """State to keep: all versions, and which of them are heads."""
    top = heads(history).select("source", F.col("revision").alias("head"))
    return history.join(top, "source").withColumn("is_head", F.col("revision") == F.col("head")).drop("head")


def restored(payload: DataFrame) -> DataFrame:
    """The history of a kept state; heads that are not the highest revision, or not one each, are an error."""
    marks = payload.groupBy("source").agg(F.count_if(F.col("is_head")).alias("n"), F.max("revision").alias("top"), F.max(F.when(F.col("is_head"), F.col("revision"))).alias("head"))
    if not marks.filter("n != 1 OR head IS NULL OR head != top").isEmpty():
        raise ValueError("heads and history contradict each other")
    return payload.drop("is_head")


def published(generation: DataFrame, events: DataFrame) -> DataFrame:
    """The generation (source, revision, ...) after events of newer revisions: their rows replace, deletions remove."""
    newest = heads(events)
    keep = generation.join(newest.select("source", F.col("revision").alias("new")), "source", "left").filter(F.col("new").isNull() | (F.col("new") <= F.col("revision"))).drop("new")
    old = generation.groupBy("source").agg(F.max("revision").alias("old"))
    more = newest.join(old, "source", "left").filter((F.col("old").isNull() | (F.col("revision") > F.col("old"))) & (F.col("op") != "delete")).select(*generation.columns)
    return keep.unionByName(more)


def versions_of(ranked: DataFrame, generation: DataFrame, versions: DataFrame) -> DataFrame:
    """The exact versions that ranked (query_id, source, rank) stand for, where the digest is the capsule's."""
    rows = ranked.join(generation.select("source", "revision", "digest"), "source").join(versions.select("source", "revision", "key", F.col("digest").alias("own")), ["source", "revision"])
    return rows.filter("digest = own").select("query_id", "rank", "key")


def relevant_as_of(judged: DataFrame, history: DataFrame) -> DataFrame:
    """Judged (query_id, source, at) with the revision in effect then; deleted or later sources are none."""
    pairs = judged.join(history.select("source", "revision", "op", "effective"), "source").filter("effective <= at")
    last = pairs.groupBy("query_id", "source").agg(F.max_by(F.struct("revision", "op"), F.struct("effective", "revision")).alias("h"))
    return last.filter("h.op != 'delete'").select("query_id", "source", F.col("h.revision").alias("revision"))


def cache_key(principal: Column, authority: Column, generation: Column, contract_: Column, query: Column, at: Column) -> Column:
    """One digest of all that a kept result depends on."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("\x1e"))
    return F.sha2(F.concat_ws("\x1f", *(part(c) for c in (principal, authority, generation, contract_, query, at))), 256)


def cached(cache: DataFrame, asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Kept results (key, item, rank) of asked (key); one whose item may no longer be seen is a miss as a whole."""
    rows = asked.select("key").distinct().join(cache, "key").join(allowed.select("item", F.lit(True).alias("may")), "item", "left")
    bad = rows.filter("may IS NULL").select("key").distinct()
    return rows.join(bad, "key", "left_anti").select("key", "item", "rank")


def kept(cache: DataFrame, key: Column, ranked: DataFrame) -> DataFrame:
    """The cache with a result put in; what was kept under the key goes."""
    new = ranked.select(key.alias("key"), "item", "rank")
    return cache.join(new.select("key").distinct(), "key", "left_anti").unionByName(new)


__all__ = ["as_of", "cache_key", "cached", "capsules", "contract", "kept", "materialized", "published", "relevant_as_of", "restored", "schedule", "state_payload", "versions_of"]
