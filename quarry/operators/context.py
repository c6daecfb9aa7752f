"""Ordered folds and interval work: packing, interleaving, coverage, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack(ranked: DataFrame, budget: int, by: str = "query_id", item: str = "item", size: str = "size") -> DataFrame:
    """(by, item, rank, used): takes each that still fits, in rank order; one that does not is skipped.

    Lists are the k ranked rows of a query, so the fold's arrays are bounded by k.
    """
    rows = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("item"), F.col(size).cast("long").alias("size")))).alias("c"))
    kind = ranked.schema[item].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<rank:int,item:{kind},used:bigint>>").alias("took"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + x["size"]
        took = F.concat(s["took"], F.array(F.struct(x["rank"].cast("int").alias("rank"), x["item"].alias("item"), used.alias("used"))))
        return F.when(used <= budget, F.struct(used.alias("used"), took.alias("took"))).otherwise(s)

    return rows.select(by, F.explode(F.aggregate("c", start, step, lambda s: s["took"])).alias("t")).select(by, "t.rank", "t.item", "t.used")


def interleave(branches: DataFrame, cap: int = 2) -> DataFrame:
    """Round robin over (query_id, branch, rank, item) without comparing scores; first place owns an item."""
    first = Window.partitionBy("query_id", "item").orderBy("rank", "branch")
    once = branches.withColumn("r", F.row_number().over(first)).filter("r = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "branch", "item")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).select("query_id", "place", "branch", "item")


def merge_intervals(rows: DataFrame, by: str = "key") -> DataFrame:
    """(by, a, z) without overlaps; intervals that touch become one."""
    w = Window.partitionBy(by).orderBy("a", "z")
    reach = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "island").agg(F.min("a").alias("a"), F.max("z").alias("z")).drop("island")


def coverage(required: DataFrame, held: DataFrame, by: str = "key") -> DataFrame:
    """(by, needed, covered): code points of the required intervals that held ones cover."""
    need, have = merge_intervals(required, by), merge_intervals(held, by).select(by, F.col("a").alias("x"), F.col("z").alias("y"))
    both = need.join(have, by, "left").withColumn("c", F.greatest(F.least("z", "y") - F.greatest("a", "x"), F.lit(0)))
    per = both.groupBy(by, "a", "z").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    return per.groupBy(by).agg(F.sum(F.col("z") - F.col("a")).alias("needed"), F.sum("c").alias("covered"))


def prompt(question: Column, texts: Column, header: str = "Answer from the context only.") -> Column:
    return F.concat_ws("\n", F.lit(header), F.array_join(texts, "\n"), F.concat(F.lit("Question: "), question))


def excerpt(texts: Column, quote: Column) -> Column:
    return F.exists(texts, lambda t: F.contains(t, quote))


def stub_answer(n_ranked: Column, n_packed: Column, has_evidence: Column) -> Column:
    """Why there is no answer, in this order of precedence; else answered."""
    return F.when(n_ranked == 0, "no_result").when(n_packed == 0, "context_empty").when(~has_evidence, "missing_required_evidence").otherwise("answered")


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """(task, needs): everything a task waits for, by doubling; stops when nothing is new."""
    reach = edges.select("task", "needs").distinct()
    known = reach.count()
    for _ in range(rounds):
        longer = reach.join(reach.select(F.col("task").alias("needs"), F.col("needs").alias("far")), "needs").select("task", F.col("far").alias("needs"))
        reach = reach.union(longer).distinct().checkpoint() if reach.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else reach.union(longer).distinct()
        now = reach.count()
        if now == known:
            break
        known = now
    return reach


def readiness(tasks: DataFrame, edges: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """(task, state): done, failed, blocked, ready or waiting; a cycle is an error."""
    reach = closure(edges)
    if not reach.filter("task = needs").isEmpty():
        raise ValueError("tasks depend on themselves")
    marks = reach.join(failed.select(F.col("task").alias("needs"), F.lit(1).alias("bad")), "needs", "left").join(done.select(F.col("task").alias("needs"), F.lit(1).alias("ok")), "needs", "left")
    marks = marks.groupBy("task").agg(F.max(F.coalesce("bad", F.lit(0))).alias("bad"), F.min(F.coalesce("ok", F.lit(0))).alias("ok"))
    rows = tasks.join(marks, "task", "left").join(done.select("task", F.lit(True).alias("d")), "task", "left").join(failed.select("task", F.lit(True).alias("f")), "task", "left")
    return rows.select("task", F.when(F.col("d"), "done").when(F.col("f"), "failed").when(F.col("bad") == 1, "blocked").when(F.coalesce("ok", F.lit(1)) == 1, "ready").otherwise("waiting").alias("state"))
