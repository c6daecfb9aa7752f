"""Routed and fan-out execution: views, at most two routes, context, and traces without texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.context import interleave, pack
from quarry.operators.lexical import small, top_k


def public_plan(plans: DataFrame) -> DataFrame:
    """Plans (query_id, text, kind, outcome, route, ...) as they may be written: digests in place of texts."""
    bounds = F.to_json(F.struct(*(c for c in ("ids", "low", "high") if c in plans.columns)))
    return plans.select("query_id", "kind", "outcome", "route", F.sha2("text", 256).alias("text_digest"), F.sha2(bounds, 256).alias("constraint_digest"))


def intent_lock(text: Column, kind: Column, authority: Column, contract: Column) -> Column:
    """What a reformulation has to carry to count as the same intent."""
    return F.sha2(F.to_json(F.struct(text.alias("t"), kind.alias("k"), authority.alias("a"), contract.alias("c"))), 256)


def routed(plans: DataFrame, view: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], k: int, failing: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, outcome, reason, route, attempts, item, rank, score), a row per result or one without.

    plans (query_id, outcome, route, other): the route and the one to try if it fails.
    view (query_id, item): what each query may see.  A route gets queries (query_id) and
    gives (query_id, item, score).  Scores of zero are no results; an empty result is final,
    only a failed route is tried again, once.
    """
    ready = plans.filter(F.col("route").isNotNull())
    seen = ready.join(view.select("query_id").distinct(), "query_id", "left_semi")
    down = F.array(*map(F.lit, failing)).cast("array<string>")
    second = F.when(F.array_contains(down, F.col("route")) & F.col("other").isNotNull(), F.col("other"))
    tried = seen.withColumn("second", second).withColumn("final", F.when(~F.array_contains(down, F.col("route")), F.col("route")).when(F.col("second").isNotNull() & ~F.array_contains(down, F.col("second")), F.col("second")))
    ranked = None
    for name, search in routes.items():
        mine = tried.filter(F.col("final") == name).select("query_id")
        got = search(mine).filter(F.col("score") > 0).join(view, ["query_id", "item"], "left_semi").join(mine, "query_id", "left_semi")
        ranked = got if ranked is None else ranked.unionByName(got)
    ranked = top_k(ranked, k, tie="item").select("query_id", "item", "rank", "score")
    rows = plans.join(tried.select("query_id", "final", (1 + F.col("second").isNotNull().cast("int")).alias("attempts")), "query_id", "left").join(ranked, "query_id", "left")
    there = F.col("attempts").isNotNull()
    outcome = F.when(F.col("route").isNull(), F.col("outcome")).when(~there, "empty").when(F.col("final").isNull(), "failed").when(F.col("item").isNull(), "empty").otherwise(F.col("outcome"))
    reason = F.when(F.col("route").isNull(), "no_route").when(~there, "no_authorized_candidates").when(F.col("final").isNull(), "retry_budget_exhausted").when(F.col("item").isNull(), "no_positive_score")
    return rows.select("query_id", outcome.alias("outcome"), reason.alias("reason"), F.col("final").alias("route"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "item", "rank", "score")


def gated_context(ranked: DataFrame, allowed: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """Context of ranked (query_id, item, rank): eligibility is asked again; an item that lost it is an error."""
    if not ranked.filter("item IS NOT NULL").join(allowed.select("item"), "item", "left_anti").isEmpty():
        raise PermissionError("eligibility changed before context")
    return pack(ranked.filter("item IS NOT NULL").join(sizes, "item"), budget, item="item")


def proposals(drafts: DataFrame, mode: str) -> DataFrame:
    """The drafts (query_id, n, mode, text) of a mode; the original mode has none."""
    if mode not in ("original", "multi", "hypothetical"):
        raise ValueError("unknown reformulation mode")
    return drafts.filter(F.lit(mode != "original") & (F.col("mode") == mode))


def fan_out(queries: DataFrame, accepted: DataFrame, search: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(query_id, place, branch, item): the original and its accepted branches, interleaved by rank.

    queries (query_id, text), accepted (query_id, n, text).  All branches are one search of
    (branch_id, text), which gives (branch_id, item, rank); scores are never compared across branches.
    """
    branches = queries.select("query_id", F.lit(0).alias("branch"), "text").unionByName(accepted.select("query_id", F.col("n").cast("int").alias("branch"), "text"))
    branches = branches.withColumn("branch_id", F.concat_ws("/", "query_id", "branch"))
    found = search(branches.select("branch_id", "text"))
    return interleave(found.join(small(branches.select("branch_id", "query_id", "branch")), "branch_id").select("query_id", "branch", "rank", "item"), k)


def plan_metrics(planned: DataFrame, expected: DataFrame) -> DataFrame:
    """(kind_ok, outcome_ok, route_ok, n): shares of planned (query_id, kind, outcome, route) that are as expected."""
    rows = expected.select("query_id", *(F.col(c).alias(f"x_{c}") for c in ("kind", "outcome", "route"))).join(planned, "query_id", "left")
    share = lambda c: F.avg(F.col(c).eqNullSafe(F.col(f"x_{c}")).cast("double")).alias(f"{c}_ok")
    return rows.agg(share("kind"), share("outcome"), share("route"), F.count("*").alias("n"))


class Collector:
    """Traces of one workload: candidates by stage, refused if they are outside the roster or not finite."""

    SCHEMA = "query_id string, mode string, status string, reason string, n long, digest string"

    def __init__(self, spark: SparkSession, workload: str, versions: dict[str, str], roster: DataFrame):
        self.spark, self.workload, self.versions, self.roster, self.rows = spark, workload, dict(versions), roster, []

    def record(self, query_id: str, mode: str, candidates: DataFrame, status: str = "ok", reason: str | None = None) -> None:
        """A summary of candidates (item, score): their number and a digest, never the rows themselves."""
        bad = F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))
        if not candidates.filter(bad).isEmpty() or not candidates.join(self.roster.select("item"), "item", "left_anti").isEmpty():
            raise ValueError("candidates outside the roster, or scores that are not finite")
        r = candidates.agg(F.count("*").alias("n"), F.sum(F.xxhash64("item", F.round("score", 9)).cast("decimal(38,0)")).alias("s")).first()
        self.rows.append((query_id, mode, status, reason, r["n"], str(r["s"])))

    @contextmanager
    def guard(self, query_id: str, mode: str) -> Iterator[None]:
        """A failure is recorded by its class alone and goes on."""
        try:
            yield
        except Exception as error:
            self.rows.append((query_id, mode, "failed", type(error).__name__, 0, ""))
            raise

    def execute(self, query_id: str, mode: str, operation: Callable[[], DataFrame]) -> DataFrame:
        with self.guard(query_id, mode):
            out = operation()
            self.record(query_id, mode, out.select("item", "score"))
            return out

    def table(self) -> DataFrame:
        rows = self.spark.createDataFrame(self.rows, self.SCHEMA)
        return rows.withColumn("workload", F.lit(self.workload)).withColumn("versions", F.lit("|".join(f"{k}={v}" for k, v in sorted(self.versions.items()))))


def pairs(result: DataFrame) -> DataFrame:
    """A result as (item, score), whatever else it carries."""
    return result.select("item", "score")
