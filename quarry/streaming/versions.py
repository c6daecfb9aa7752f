"""The event log as a stream: keyed version state, windows, an idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "source long, revision long, event_id string, received long, reason string"
STATE = "head long, events array<string>, revisions array<long>, payloads array<string>"


def reduce_events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each event's outcome, against the source's head and receipts."""
    head, events, revisions, payloads = state.get if state.exists else (-1, [], [], [])
    events, known = list(events), dict(zip(revisions, payloads))
    out = []
    rows = pd.concat(list(batches)).sort_values(["received", "event_id"])
    seen = set(events)
    for r in rows.itertuples(index=False):
        if r.event_id in seen:
            reason = "duplicate_event"
        elif r.revision in known:
            reason = "duplicate_revision" if known[r.revision] == r.payload else "conflict"
        else:
            reason = "stale_revision" if r.revision < head else "accepted"
            known[r.revision] = r.payload
        seen.add(r.event_id)
        head = max(head, r.revision)
        out.append((key[0], r.revision, r.event_id, r.received, reason))
    state.update((int(head), sorted(seen), [int(k) for k in known], list(known.values())))
    yield pd.DataFrame(out, columns=["source", "revision", "event_id", "received", "reason"])


def versioned(stream: DataFrame) -> DataFrame:
    """(source, revision, event_id, payload, received) -> outcomes, one state per source."""
    return stream.groupBy("source").applyInPandasWithState(reduce_events, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums per event type and window, with a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def upsert_into(path: str, key: str, revision: str):
    """A foreachBatch sink of versions: repeated batches write the same directory again."""

    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(key).orderBy(F.desc(revision))
        batch.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark, path: str, key: str, revision: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(revision, "batch")).alias("r")).select(key, "r.*")
