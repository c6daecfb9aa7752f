"""Corpora, judgements, snapshots and raw files, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.identity import digest

CORPUS = """snapshot string, documents array<struct<id:string,title:string,version:string,effective_on:string,
allowed_scopes:array<string>,status:string,sections:array<struct<span:string,text:string>>>>"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse(bad: DataFrame, why: str) -> None:
    if rows := bad.limit(3).collect():
        raise ValueError(f"{why}: {rows}")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A row per section of a corpus file; refused if ids, versions, scopes or spans are wrong."""
    raw = spark.read.schema(CORPUS).json(path, multiLine=True)
    refuse(raw.filter("snapshot IS NULL"), "no snapshot")
    docs = raw.select("snapshot", F.explode("documents").alias("d")).select("snapshot", "d.*")
    refuse(docs.groupBy("id").count().filter("count > 1"), "repeated documents")
    refuse(docs.filter("version IS NULL OR allowed_scopes IS NULL OR size(allowed_scopes) = 0").select("id"), "no version or scope")
    rows = docs.select("*", F.posexplode("sections").alias("section_order", "s")).drop("sections").select("*", F.col("s.span").alias("source_span"), F.col("s.text").alias("text")).drop("s")
    refuse(rows.groupBy("id", "source_span").count().filter("count > 1"), "repeated spans")
    return rows


def qrels(queries: DataFrame, roster: DataFrame, grades: DataFrame) -> DataFrame:
    """The whole roster for each query, absent grades 0; a grade outside the roster is refused.

    queries and roster are a judged set, so their product is the judgement matrix itself.
    """
    refuse(grades.join(roster, "item", "left_anti"), "ineligible items are judged")
    refuse(grades.groupBy("query_id", "item").count().filter("count > 1"), "an item is judged twice")
    return queries.select("query_id").crossJoin(F.broadcast(roster.select("item"))).join(grades, ["query_id", "item"], "left").select("query_id", "item", F.coalesce("grade", F.lit(0)).alias("grade"))


def disjoint(rows: DataFrame, key: str, split: str) -> None:
    refuse(rows.groupBy(key).agg(F.count_distinct(split).alias("n")).filter("n > 1"), "splits share keys")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of raw files."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2(F.col("content"), 256).alias("sha256"))


def save_snapshot(df: DataFrame, path: str, key: str, **contract: str) -> str:
    """The rows and a one-row manifest with their digest; returns the digest."""
    spark = df.sparkSession
    rows = df.withColumn("_digest", digest(*(F.to_json(F.struct(c)) for c in df.columns)))
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows")
    one = kept.agg(F.sum(F.conv(F.substring("_digest", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("s"), F.count("*").alias("n")).first()
    version = f"{one['n']}:{one['s']}"
    spark.createDataFrame([(version, key, *contract.values())], ["digest", "key", *contract]).coalesce(1).write.parquet(f"{path}/manifest")
    return version


def load_snapshot(spark: SparkSession, path: str, expected: str, **contract: str) -> DataFrame:
    """The rows, if manifest, contract and recomputed digests all agree."""
    head = spark.read.parquet(f"{path}/manifest").first().asDict()
    if head["digest"] != expected or any(head.get(k) != v for k, v in contract.items()):
        raise ValueError("the snapshot is not the expected one")
    rows = spark.read.parquet(f"{path}/rows")
    names = [c for c in rows.columns if c != "_digest"]
    refuse(rows.filter(digest(*(F.to_json(F.struct(c)) for c in names)) != F.col("_digest")).select(head["key"]), "rows differ from their digests")
    one = rows.agg(F.sum(F.conv(F.substring("_digest", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("s"), F.count("*").alias("n")).first()
    if f"{one['n']}:{one['s']}" != expected:
        raise ValueError("rows are missing")
    return rows.select(*names)


def same_table(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings by buckets of their term, sorted: a term's lookup reads one bucket."""
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("term", "seg").write.partitionBy("bucket").mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """Postings of some terms: partition pruning, then a pushed filter."""
    wanted = spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")).distinct().collect()
    return spark.read.parquet(path).filter(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(terms)).drop("bucket")


def traces(run: DataFrame, roster: DataFrame, path: str, workload: str) -> None:
    """Append candidate traces; items outside the roster or scores that are not finite are refused."""
    refuse(run.join(roster.select("item"), "item", "left_anti"), "items outside the roster")
    refuse(run.filter(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))), "scores that are not finite")
    run.withColumn("workload", F.lit(workload)).withColumn("recorded", F.current_timestamp()).write.mode("append").partitionBy("workload").parquet(path)
