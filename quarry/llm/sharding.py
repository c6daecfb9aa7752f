"""Fixed virtual slots, a versioned slot-to-shard map, and rebalancing by edits.

Records hash into ``SLOTS`` virtual slots that never change; only the map from slots to
shards does.  Bytes are aggregated per slot, so whatever the table's size the map is
edited over a few thousand numbers.  An edit moves or swaps slots from the fullest shard
to the emptiest while that brings them nearer, and is stored as the next version.

The law is ``bytes``: sizes of shards are near equal.  ``slot`` is a record's position in
its shard, gapless from 0.  Defined results: a null text has size 1 and crc32 0; a null
doc_id is a record like any other; equal rows stay in one slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import settle, table_path

SLOTS = 4096
SHARDS = 16
MAP_SCHEMA = "version int, vslot int, shard int"


def initial_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """The map after edits: moves, then swaps, between the fullest and the emptiest shard."""
    owner = list(owner)
    members: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    for s, k in enumerate(owner):
        members[k].add(s)
        load[k] += weight[s]
    for _ in range(4 * len(owner)):
        top, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[top] - load[low]
        if gap <= 1:
            break
        # to move x leaves a gap of |gap - 2 x|; the best is half the gap
        best = min(((abs(gap - 2 * weight[s]), s, None) for s in members[top] if 0 < weight[s] < gap), default=None)
        small = sorted((weight[s], s) for s in members[low])
        for s in members[top]:
            # a swap moves weight[s] - weight[r]: look next to the best partner
            lo, hi, goal = 0, len(small), weight[s] - gap / 2
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if small[mid][0] < goal else (lo, mid)
            for w, r in small[max(0, lo - 1) : lo + 1]:
                moved = weight[s] - w
                if 0 < moved < gap and (best is None or abs(gap - 2 * moved) < best[0]):
                    best = (abs(gap - 2 * moved), s, r)
        if best is None or best[0] >= gap:
            break
        _, s, r = best
        for slot, a, b in ((s, top, low), *(() if r is None else ((r, low, top),))):
            members[a].discard(slot)
            members[b].add(slot)
            load[a] -= weight[slot]
            load[b] += weight[slot]
            owner[slot] = b
    return owner


def save_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    rows = [(version, s, k) for s, k in enumerate(owner)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, DataFrame]:
    """A version of the map, or the newest."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return version, table.filter(F.col("version") == version).select("vslot", "shard")


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each record."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version for each record.

    Continues the map at ``map_path`` if there is one, else begins one; the edited map is
    stored as the next version.
    """
    spark = docs.sparkSession
    rows = settle(slotted(docs, slots))
    totals = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    weight, count = [0] * slots, [0] * slots
    for r in totals.collect():  # at most one row per virtual slot
        weight[r["vslot"]], count[r["vslot"]] = r["bytes"], r["n"]
    if map_path is None:
        map_path = table_path(spark, "slot_map")
        save_map(spark, map_path, 1, initial_map(shards, slots))
    version, kept = load_map(spark, map_path)
    owner = initial_map(shards, slots)
    for r in kept.collect():
        owner[r["vslot"]] = r["shard"] % shards
    owner = rebalanced(owner, weight, shards)
    save_map(spark, map_path, version + 1, owner)
    # where each slot's records begin in their shard
    begin, at = [], [0] * shards
    for s in range(slots):
        begin.append(at[owner[s]])
        at[owner[s]] += count[s]
    table = spark.createDataFrame([(s, owner[s], begin[s], version + 1) for s in range(slots)], "vslot int, shard int, begin long, map_version int")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("place", place)
        .join(F.broadcast(table), "vslot")  # one row per virtual slot
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
    )
