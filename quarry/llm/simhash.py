"""SimHash near-duplicates, searched with pivot distance tables.

1. Fingerprints: one narrow pass over the texts (XXH64 of each 3-word shingle, seed 42).
2. Equal fingerprints collapse to one, whatever their ids, so copies never meet in a bucket.
3. Two fingerprints with at most two differing bits agree on two of four 16-bit blocks:
   six buckets hold each representative.  A bucket of more than ``HOT`` members is dealt
   again by its distances to two pivots, which differ by at most two for linked ones.
4. In a bucket, rows are sorted by the distance to one reference fingerprint; a table of
   Hamming distances to references (``pivots``) discards pairs whose largest coordinate
   difference is over two; survivors are verified bit by bit.  A walk over unvisited
   rows gives a spanning forest: never more links than rows.
5. Components over fingerprints, each named by its smallest doc_id, then back to all documents.

Defined results: a null or blank text has the fingerprint zero and is linked like any
other; fewer than three words hash as one shingle; repeated rows get one row each;
a null ``doc_id`` never becomes a component's id unless all of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import copies
from quarry.llm.common import doc_texts, parts, settle
from quarry.llm.components import connected_components
from quarry.llm.pivots import REFERENCES, linked

SHINGLE = 3
SEED = 42
MAX_BITS = 2
HOT = 4096


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit set where over half of the shingles' hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    one = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    total = np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        b = min(n, a + 65536)
        h = np.array([one(joined[i:j], seed) for i, j in zip(starts[a:b].tolist(), ends[a + width - 1 : b + width - 1].tolist())], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in b["text"].cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, fp long")


def _links_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys; a run may go on in the next batch."""

    def found(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        src, dst = [], []
        for k in np.flatnonzero(np.diff(cut) > 1):
            a, b = cut[k], cut[k + 1]
            for i, j in linked(fps[a:b], MAX_BITS):
                src.append(int(ids[a + i]))
                dst.append(int(ids[a + j]))
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    held: list[np.ndarray] | None = None
    for b in batches:
        now = [np.asarray(b["key"]), np.asarray(b["fp"]).view(np.uint64), np.asarray(b["rep"])]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1], side="left"))
        held = [x[last:] for x in now]
        if last:
            yield found(*(x[:last] for x in now))
    if held is not None and len(held[0]):
        yield found(*held)


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(src, dst): a spanning forest, bucket by bucket, over rows (fp, rep)."""
    n = parts(distinct.sparkSession)
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*(F.struct(F.lit(k).alias("pair"), (F.shiftleft(block(i), 16) + block(j)).alias("bits")) for k, (i, j) in enumerate(pairs)))
    rows = distinct.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", (F.shiftleft("k.pair", 32) + F.col("k.bits")).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    rows = rows.join(sizes, "bucket")
    one, two = (F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(REFERENCES[i].astype(np.int64))))) for i in (1, 2))
    # at home in the cell of its two distances; a guest where a linked row may be at home
    steps = [(0, 0)] + [(a, b) for a in range(MAX_BITS + 1) for b in range(-MAX_BITS, MAX_BITS + 1) if a or b > 0]
    cells = F.array(*((one + a) * 128 + two + b + 2 for a, b in steps))
    cells = F.when(F.col("members") > hot, cells).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("cell", F.explode(cells)).select(F.xxhash64("bucket", "cell").alias("key"), "fp", "rep")
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links_of_runs, "src long, dst long")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint and component_id of each row."""
    fps = settle(fingerprints(docs))
    distinct = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # a fingerprint stands for itself: one that only rows without a doc_id have links others too
    parents = connected_components(links(distinct.select("fp", F.col("fp").alias("rep")), hot))
    classes = distinct.join(parents.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    classes = settle(classes)
    ids = settle(classes.groupBy("class").agg(F.min("first").alias("component_id")))
    # a class may be most of the table: cut off on both sides, so that the join can split it
    classes = settle(classes.join(ids, "class").select("fp", "component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies: the first by doc_id, then by the text's hash.

    Near copies share at least ``similarity`` of their shingles of ``width`` words (Jaccard);
    their fingerprints are mostly further apart than ``MAX_BITS``, so ``copies`` takes wider
    ones and a wider bound, with pivots as here, and compares what is left exactly.
    A group is made of texts, whatever their ids: different texts with one doc_id, or with
    none, are as apart as any.  A row without a doc_id comes last in its group.  Of repeated
    rows with the first's doc_id and text one stays; all columns stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    quoted = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rows = docs.select(F.struct(*quoted).alias("all"), F.col("doc_id").alias("id"), text.alias("t"))
    rows = rows.select("all", "id", "t", F.xxhash64("t").alias("node"), F.xxhash64(F.col("id").isNull(), "id", "t").alias("row"))
    found = copies.groups(rows.select("node", F.col("t").alias("text")), width, similarity)
    members = rows.select("id", "row", "node").join(found, "node", "left")
    first = F.min(F.struct(F.col("id").isNull(), "id", "node", "row"))
    keep = settle(members.groupBy(F.coalesce("component", "node").alias("group")).agg(first.alias("first")).select(F.col("first.row").alias("row")))
    return rows.dropDuplicates(["row"]).join(keep, "row", "left_semi").select("all.*")
