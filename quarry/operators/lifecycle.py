"""Event logs: heads, as-of versions, transitions, generations and cutover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def transitions(events: DataFrame) -> DataFrame:
    """Each event's outcome in delivery order: accepted, duplicate_event, duplicate_revision,
    conflict or stale_revision.

    events: (source, revision, event_id, payload, received).  Only a source's own events
    are ordered, so a source is one window partition.
    """
    order = Window.partitionBy("source").orderBy("received", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    same_event = F.row_number().over(Window.partitionBy("source", "event_id").orderBy("received"))
    head = F.max("revision").over(before)
    same_revision = Window.partitionBy("source", "revision").orderBy("received", "event_id")
    first_payload = F.first("payload").over(same_revision)
    again = F.row_number().over(same_revision)
    rows = events.withColumn("e", same_event).withColumn("head", head).withColumn("r", again).withColumn("fp", first_payload)
    reason = F.when(F.col("e") > 1, "duplicate_event").when((F.col("r") > 1) & (F.col("fp") == F.col("payload")), "duplicate_revision").when(F.col("r") > 1, "conflict").when(F.col("revision") < F.col("head"), "stale_revision").otherwise("accepted")
    return rows.select("source", "revision", "event_id", "received", reason.alias("reason"))


def heads(events: DataFrame, key: str = "source", revision: str = "revision") -> DataFrame:
    """The event of the highest revision of each source."""
    row = F.struct(*events.columns)
    return events.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(revision, "event_id")).alias("h")).select("h.*")


def as_of(events: DataFrame, at, key: str = "source") -> DataFrame:
    """The last version in effect at a time."""
    return events.filter(F.col("effective") <= at).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*events.columns), F.struct("effective", "revision")).alias("h")).select("h.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the right value in effect: union, then the last value before it.

    One exchange by key and no pairs, whatever the number of versions.
    """
    a = left.select(F.col(key).alias("k"), F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.struct(*left.columns).alias("row"))
    b = right.select(F.col(key).alias("k"), F.col(right_time).alias("t"), F.lit(0).alias("side"), F.col(value).alias("v"), F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("side = 1").select("row.*", F.col("v").alias(value))


def live(events: DataFrame) -> DataFrame:
    """Heads that are no tombstones."""
    return heads(events).filter(F.col("op") != "delete")


def fresh(index: DataFrame, authority: DataFrame) -> DataFrame:
    """Index rows whose version is the authority's: equal digests, else the row waits."""
    a = authority.select("source", F.col("payload").alias("expected"))
    return index.join(a, "source").filter(F.col("payload") == F.col("expected")).drop("expected")


def duplicates(docs: DataFrame, *by: str) -> DataFrame:
    """Groups of equal bodies within the same policy columns: (digest, n, first)."""
    return docs.groupBy(F.sha2(F.col("text"), 256).alias("digest"), *by).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


class Generations:
    """Named index tables, one of which is active; a cutover compares and swaps."""

    def __init__(self, spark: SparkSession, view: str):
        self.spark, self.view = spark, view
        self.known: dict[str, tuple[DataFrame, str]] = {}
        self.active: str | None = None

    def add(self, name: str, table: DataFrame, state: str) -> None:
        if name in self.known:
            raise ValueError(f"generation {name} exists")
        self.known[name] = (table, state)

    def cutover(self, expected: str | None, target: str, authority_state: str) -> None:
        if self.active != expected:
            raise ValueError(f"{self.active} is active, not {expected}")
        table, state = self.known[target]
        if state != authority_state:
            raise ValueError("the generation is behind the authority")
        table.createOrReplaceTempView(self.view)
        self.active = target


def state_digest(spark_rows: DataFrame) -> str:
    """One digest of (source, revision, payload) rows, without gathering them: a sum of row hashes."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "source", "revision", "payload"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = spark_rows.agg(F.coalesce(F.sum(h), F.lit(0)).alias("s"), F.count("*").alias("n")).first()
    return f"{r['n']}:{r['s']}"
