"""Interpreting, routing and reformulating queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import atoms, squeeze

#: Kind -> routes in order of preference.
ROUTES = {"identifier": ("lexical",), "keyword": ("lexical", "dense"), "semantic": ("dense", "lexical"), "aggregate": ("sql",), "relation": ("graph",), "current": ("web",)}
LOCAL = ("lexical", "dense")


def kind(text: Column) -> Column:
    """The closed grammar's class of a question."""
    t = F.lower(text)
    return (
        F.when(text.rlike(r"\b[A-Z]+-[0-9]+\b"), "identifier")
        .when(t.rlike(r"\b(how many|count|average|total)\b"), "aggregate")
        .when(t.rlike(r"\b(depends on|related to|connected)\b"), "relation")
        .when(t.rlike(r"\b(latest|today|right now)\b"), "current")
        .when(F.size(F.split(F.trim(t), r"\s+")) <= 3, "keyword")
        .otherwise("semantic")
    )


def route(kind_: Column, available: tuple[str, ...] = LOCAL, ambiguous: Column | None = None) -> Column:
    """struct(outcome, route): ready, partial (a fallback), clarify or unsupported."""
    out = F.struct(F.lit("unsupported").alias("outcome"), F.lit(None).cast("string").alias("route"))
    for name, wanted in ROUTES.items():
        there = [r for r in wanted if r in available]
        if there:
            out = F.when(kind_ == name, F.struct(F.lit("ready" if there[0] == wanted[0] else "partial").alias("outcome"), F.lit(there[0]).alias("route"))).otherwise(out)
    if ambiguous is not None:
        out = F.when(ambiguous, F.struct(F.lit("clarify").alias("outcome"), F.lit(None).cast("string").alias("route"))).otherwise(out)
    return out


def days(text: Column) -> Column:
    """struct(low, high) of a day or a range of days, half-open."""
    found = F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    first = F.try_to_date(F.get(found, 0))
    last = F.try_to_date(F.get(found, F.size(found) - 1))
    return F.when(F.size(found) > 0, F.struct(first.alias("low"), F.date_add(last, 1).alias("high")))


def interpret(queries: DataFrame, available: tuple[str, ...] = LOCAL) -> DataFrame:
    """(query_id, kind, outcome, route, ids, low, high)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]+-[0-9]+\b"), F.lit(0))))
    rows = queries.select("query_id", kind(text).alias("kind"), ids.alias("ids"), days(text).alias("d"), (F.trim(text) == "").alias("empty"))
    return rows.withColumn("r", route(F.col("kind"), available, F.col("empty"))).select("query_id", "kind", "r.outcome", "r.route", "ids", "d.low", "d.high")


def admit(proposals: DataFrame, max_branches: int = 3, max_words: int = 128) -> DataFrame:
    """Each proposal's fate, in order: anchor, atom, duplicate, branches, words, accepted.

    proposals: (query_id, n, text, lock, expected, original).  The original has the first
    branch and its words count.  A proposal may leave atoms of the original out but bring
    none of its own; texts that differ in case only are duplicates.
    Budgets depend on what was accepted before, so it is a fold over a query's few proposals.
    """
    size = lambda t: F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+")))
    told = lambda t: F.transform(atoms(t), F.lower)
    text, original = squeeze(F.coalesce("text", F.lit(""))), squeeze(F.coalesce("original", F.lit("")))
    whole = F.size(F.array_except(told(text), told(original))) == 0
    one = F.struct("n", text.alias("text"), F.coalesce(F.col("lock") == F.col("expected"), F.lit(False)).alias("anchored"), whole.alias("whole"), size(text).alias("w"))
    rows = proposals.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("p"), F.first(original).alias("o"))
    start = F.struct(F.array().cast("array<struct<n:int,text:string,reason:string>>").alias("out"), F.array(F.lower("o")).alias("seen"), size(F.col("o")).alias("w"))

    def step(s: Column, x: Column) -> Column:
        key = F.lower(x["text"])
        reason = (
            F.when(~x["anchored"], "anchor").when(~x["whole"], "protected_atom").when(F.array_contains(s["seen"], key), "duplicate")
            .when(F.size(s["seen"]) >= max_branches, "branch_budget").when(s["w"] + x["w"] > max_words, "word_budget").otherwise("accepted")
        )
        out = F.concat(s["out"], F.array(F.struct(x["n"].cast("int").alias("n"), x["text"].alias("text"), reason.alias("reason"))))
        ok = reason == "accepted"
        return F.struct(out.alias("out"), F.when(ok, F.concat(s["seen"], F.array(key))).otherwise(s["seen"]).alias("seen"), (s["w"] + F.when(ok, x["w"]).otherwise(0)).alias("w"))

    return rows.select("query_id", F.explode(F.aggregate("p", start, step, lambda s: s["out"])).alias("o")).select("query_id", "o.*")


def feedback_terms(ranked: DataFrame, tokens: DataFrame, n: int) -> DataFrame:
    """The n terms that most of a query's top segments share: (query_id, term)."""
    near = ranked.join(tokens, "seg").select("query_id", "seg", F.explode(F.array_distinct("tokens")).alias("term"))
    counts = near.groupBy("query_id", "term").agg(F.count("*").alias("c"))
    w = Window.partitionBy("query_id").orderBy(F.desc("c"), "term")
    return counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("query_id", "term")
