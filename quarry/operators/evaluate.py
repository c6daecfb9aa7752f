"""Ranking metrics, macro and micro means, percentiles, settings chosen by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row per judged query; undefined metrics (no positives) are null.

    run: (query_id, item, rank); qrels: (query_id, item, grade), an absent grade is 0.
    """
    judged = qrels.groupBy("query_id").agg(F.sum((F.col("grade") > 0).cast("int")).alias("n_rel"))
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "item")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    ideal = qrels.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("idcg"))
    top = run.filter(F.col("rank") <= k).join(qrels, ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0))).withColumn("hit", (F.col("grade") > 0).cast("int"))
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("hits", F.sum("hit").over(seen))
    got = top.groupBy("query_id").agg(F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("ap"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    rows = judged.join(ideal, "query_id", "left").join(got, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    some = F.col("n_rel") > 0
    p, r = F.col("hits") / float(k), F.try_divide(F.col("hits").cast("double"), F.col("n_rel").cast("double"))
    return rows.select(
        "query_id", "n_rel", "hits", p.alias("precision"), F.when(some, r).alias("recall"), F.when(some, (F.col("hits") > 0).cast("int")).alias("hit"),
        F.when(some, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).alias("f1"), F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"),
        F.when(some, F.coalesce(F.col("ap"), F.lit(0.0)) / F.least("n_rel", F.lit(k))).alias("ap"), F.when(some, F.try_divide(F.coalesce("dcg", F.lit(0.0)), "idcg")).alias("ndcg"),
    )


def summary(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro means over queries with positives, micro recall, the share without positives."""
    return per_query.groupBy(*(by or [])).agg(
        F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ap").alias("map"),
        F.try_divide(F.sum(F.when(F.col("n_rel") > 0, F.col("hits"))).cast("double"), F.sum("n_rel").cast("double")).alias("micro_recall"), F.avg((F.col("n_rel") == 0).cast("int")).alias("no_positive"),
    )


def nearest_rank(value: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def choose(grid: DataFrame, score: str, default: dict, params: list[str]) -> DataFrame:
    """The setting with the best score; ties to the default, then the nearest to it, then the smallest."""
    is_default, away = F.lit(True), F.lit(0.0)
    for p in params:
        is_default, away = is_default & (F.col(p) == default[p]), away + F.abs(F.col(p) - default[p])
    key = F.struct((-F.round(score, 9)).alias("s"), (~is_default).alias("d"), F.round(away, 9).alias("a"), *params)
    return grid.agg(F.min_by(F.struct(*params, F.col(score).alias(score)), key).alias("b")).select("b.*")


def crossing(rows: DataFrame, family: str, split: str) -> DataFrame:
    """Families that appear in more than one split."""
    return rows.groupBy(family).agg(F.sort_array(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)
