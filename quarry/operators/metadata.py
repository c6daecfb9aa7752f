"""Typed metadata: validation, ingestion, authorised postings, independent checks, plan quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED = ("record_id", "tenant", "owner", "entity", "parent_id")


def problem(schema: str, policy: str) -> Column:
    """Null for a valid row, else the first thing that is wrong with it.

    Rows: schema_version, policy_version, the named ids, version, roles, language,
    confidence, published_at and updated_at (texts with a zone).
    """
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    no_zone = lambda c: F.col(c).isNull() | ~F.col(c).rlike(r"(?:Z|[+-][0-9]{2}:[0-9]{2})$") | F.try_to_timestamp(F.col(c)).isNull()
    out = F.when(F.coalesce(F.col("schema_version") != schema, F.lit(True)) | F.coalesce(F.col("policy_version") != policy, F.lit(True)), "version")
    for c in NAMED:
        out = out.when(missing(c), "identity")
    roles = F.col("roles")
    out = out.when(F.col("version").isNull() | (F.col("version") < 1), "source_version")
    out = out.when(roles.isNull() | (F.size(roles) == 0) | F.exists(roles, lambda r: r.isNull() | (r == "")), "roles").when(F.size(F.array_distinct(roles)) < F.size(roles), "repeated_role")
    out = out.when(F.col("language") == "", "language").when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence")
    return out.when(no_zone("published_at") | no_zone("updated_at"), "instant")


def ingested(rows: DataFrame, schema: str, policy: str) -> DataFrame:
    """All rows with ``status``: valid ones are ready, the others blocked with their problem."""
    p = problem(schema, policy)
    return rows.withColumn("problem", p).withColumn("status", F.when(F.col("problem").isNull(), "ready").otherwise("blocked"))


def manifest_rows(docs: DataFrame, rows: DataFrame, *fields: str) -> DataFrame:
    """(record_id, text digest, metadata digest) of each document with metadata."""
    meta = F.sha2(F.to_json(F.struct(*fields)), 256)
    return docs.select("record_id", F.sha2("text", 256).alias("text_digest")).join(rows.select("record_id", meta.alias("metadata_digest")), "record_id")


def field_postings(view: DataFrame, *fields: str) -> DataFrame:
    """(field, value, record_id) of an authorised view; null values are in no posting."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return view.select("record_id", each.alias("p")).select("p.field", "p.value", "record_id").filter("value IS NOT NULL")


def selected(postings: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Records that have all the wanted values: one grouping, no chain of joins."""
    pair = F.lit(False)
    for f, v in wanted.items():
        pair = pair | ((F.col("field") == f) & (F.col("value") == v))
    hit = postings.filter(pair)
    return hit.groupBy("record_id").agg(F.count_distinct("field").alias("n")).filter(F.col("n") == len(wanted)).select("record_id")


def disagreements(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(query_id, record_id, side): what a predicate finds and reviewers did not, or the other way round."""
    a, b = found.select("query_id", "record_id"), reviewed.select("query_id", "record_id")
    return a.exceptAll(b).withColumn("side", F.lit("found")).unionByName(b.exceptAll(a).withColumn("side", F.lit("reviewed")))


def bad_evidence(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Labels (label_id, doc_id, a, z, text) whose text does not stand at their place."""
    rows = labels.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id", "left")
    return rows.filter(F.coalesce(F.substring(F.col("body"), F.col("a") + 1, F.col("z") - F.col("a")) != F.col("text"), F.lit(True))).select("label_id")


def plan_quality(ranked: DataFrame, relevant: DataFrame, eligible: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Per query of (query_id, item) rows: recall, precision, violations and recall of the exact plan's result.

    Eligible items without a query_id are those of every query; they are counted once.
    """
    if "query_id" not in eligible.columns:
        items = eligible.select("item").distinct()
        used = ranked.select("query_id", "item").union(relevant.select("query_id", "item")).union(exact.select("query_id", "item")).distinct()
        rows = plan_quality(ranked, relevant, used.join(items, "item", "left_semi"), exact, k)
        total = F.broadcast(items.agg(F.count("*").alias("eligible")))
        return rows.drop("eligible").crossJoin(total).select(*rows.columns)
    mark = lambda df, name: df.select("query_id", "item", F.lit(1).alias(name)).distinct()
    rows = mark(ranked, "r").join(mark(relevant, "g"), ["query_id", "item"], "full").join(mark(eligible, "e"), ["query_id", "item"], "full").join(mark(exact, "x"), ["query_id", "item"], "full")
    n = lambda c: F.count_if(c)
    r, g, e, x = (F.col(c).isNotNull() for c in "rgex")
    return rows.groupBy("query_id").agg(
        F.try_divide(n(r & g), n(g)).alias("recall"), (n(r & g) / k).alias("precision"), n(r & ~e).alias("violations"), F.try_divide(n(r & x), n(x)).alias("exact_recall"), n(e).alias("eligible"), F.when(n(g) == 0, n(r) == 0).alias("empty_correct")
    )
