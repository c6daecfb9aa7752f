"""Near copies by the share of common shingles: SimHash and pivots propose, exact sets decide.

1. One narrow pass over the texts: a SimHash of ``64 * WORDS`` bits of the distinct shingles.
   A bit differs with a chance that the similarity bounds (``flips``); 64 bits would be too
   few: a pair at 0.8 differs in ten, give or take three, and so do many that are unlike.
2. Fingerprints meet in buckets: all bits of a block agree.  Blocks have more bits as texts
   are more, so that a bucket of unlike texts holds about ``ROWS``; the count of blocks
   follows, so that a pair just at the similarity is missed with a chance of ``MISS``.
   In a bucket, tables of distances to pivots, members of the bucket, discard pairs
   (``pivots``), and the first ``CHECK`` words decide on the others.  What is linked is a cell.
3. Texts that are equal are one node.  Each cell has its smallest node as head, and each
   member is compared with the heads of its cells: never more pairs than blocks times texts.
   A head's members are dealt to tasks by ``DEAL`` at once, each with the head's text, and
   go through one by one: a task holds one head and one member.
4. A cell whose members are still of more than one group has pairs that no head has seen.
   Blocks of bits repeat the same texts, so such cells that share a group are one web, in which
   a text is once; where its cells apart are fewer rows to deal, they stay apart.  A web is compared
   whole, where it has up to about ``BLOCK_BYTES`` of text and ``BLOCK_ROWS`` rows; a larger one
   is dealt as pairs of blocks of half as much, so every pair of two groups meets.
   Blocks of its largest group do not meet each other: what is linked is not dealt by its square.
5. The components of all links are the groups.

Defined results: words and case as in ``simhash``; a text of fewer words than the width is
one shingle; null and blank texts have no shingle and are copies of each other; an empty
table has no groups; a very long text is held alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import parts, settle
from quarry.llm.components import connected_components
from quarry.llm.kernels import mix
from quarry.llm.pivots import clusters

SEED = 42
MISS = 1e-4
#: Words of a fingerprint, and how many of them decide; unlike texts of a bucket.
WORDS, CHECK, ROWS = 16, 4, 64
#: Texts of at most so many shingles meet in blocks of their own as well, with a wider bound.
FEW = 5
_STREAMS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_FPS = [f"fp{i}" for i in range(CHECK)]
#: Blocks of texts of few shingles are numbered from here.
_OWN = 1 << 20
#: The bits of a byte, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Members of one head in one task.
DEAL = 64
#: Bytes of text, and rows, of what is compared whole: a web or cell, or a pair of blocks of a larger one.
BLOCK_BYTES = 16_000_000
BLOCK_ROWS = 256


def flips(similarity: float, few: bool) -> float:
    """The largest chance that a bit of two texts at the similarity differs.

    The angle of two sets is largest where they are of one size.  Ties of even sizes add to
    it: at 0.8 by 0.0097 at most (12 of 15 shingles), and by 0.0361 for four of five.
    """
    return 0.0 if similarity >= 1 else math.acos(2 * similarity / (1 + similarity)) / math.pi + (0.037 if few else 0.01)


def bands(similarity: float, size: int, few: bool) -> int:
    """Blocks of so many bits that a pair at the similarity escapes with a chance of MISS."""
    meet = (1 - flips(similarity, few)) ** size
    return 1 if meet >= 1 else math.ceil(math.log(MISS) / math.log1p(-meet))


def block_bits(nodes: int) -> int:
    """Bits of a block, so that about ROWS of so many unlike texts agree on them."""
    return min(24, max(8, round(math.log2(max(nodes, 1) / ROWS))))


def bound(similarity: float, few: bool) -> int:
    """Bits that may differ in CHECK words: four deviations over the mean."""
    p, n = flips(similarity, few), 64 * CHECK
    return math.ceil(n * p + 4 * math.sqrt(n * p * (1 - p)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes, as bytes: a bit is set where over half of them have it."""
    total = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):  # a lane counts to 255
        some = mix(hashes[i : i + 255, None] + _STREAMS)
        total += _LANES[some.view(np.uint8)].sum(axis=0).view(np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little")


def places(blocks: int, size: int) -> np.ndarray:
    """The bits of each block, by a rule: none is taken again before all are taken."""
    n = 64 * WORDS
    turns = [np.argsort(mix(np.arange(n * t + 1, n * t + n + 1, dtype=np.uint64)), kind="stable") for t in range(-(-blocks * size // n))]
    return np.concatenate(turns)[: blocks * size].reshape(blocks, size)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    one = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([one(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([one(joined[i:j], SEED) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64))


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """node, bytes of its text, whether it has few shingles, and the fingerprint, of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            few, found = [], []
            for t in b["text"].cast(pa.binary()):
                own = shingles(t.as_py(), width)
                few.append(len(own) <= FEW)
                found.append(fingerprint(own).tobytes())
            sizes = pc.fill_null(pc.binary_length(b["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b["node"], sizes, pa.array(few, pa.bool_()), pa.array(found, pa.binary())], names=["node", "bytes", "few", "print"])

    return rows.mapInArrow(run, "node long, bytes long, few boolean, print binary")


def _dealt(signed: DataFrame, size: int, similarity: float) -> DataFrame:
    """key, node and the CHECK words, a row for each block."""
    usual, more = bands(similarity, size, False), bands(similarity, size, True)
    at, powers = places(usual + more, size), (1 << np.arange(size)).astype(np.float32)
    names = np.arange(usual + more) + np.where(np.arange(usual + more) < usual, 0, _OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1024):
                b = whole.slice(a, 1024)
                raw = np.frombuffer(b"".join(b["print"].to_pylist()), np.uint8).reshape(len(b), 8 * WORDS)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                keys = np.stack([(bits[:, x] @ powers).astype(np.int64) + (int(k) << 32) for k, x in zip(names, at)], axis=1)
                n = np.where(b["few"].to_numpy(zero_copy_only=False), usual + more, usual)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(keys[np.arange(usual + more) < n[:, None]]))
                words = [pa.array(x) for x in np.ascontiguousarray(raw[:, : 8 * CHECK]).view(np.int64).T]
                yield pa.RecordBatch.from_arrays([b["node"], lists, *words], names=["node", "keys", *_FPS])

    rows = signed.mapInArrow(run, "node long, keys array<long>, " + ", ".join(f"{c} long" for c in _FPS))
    return rows.select(F.explode("keys").alias("key"), "node", *_FPS)


def _cells(rows: DataFrame, similarity: float) -> DataFrame:
    """(bucket, node) of cells of two or more, of rows in runs of equal keys; a run may go on in the next batch."""

    usual, wide = bound(similarity, False), bound(similarity, True)

    def found(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        label = clusters(keys, fps, np.where(keys >> 32 < _OWN, usual, wide))
        many = np.bincount(label, minlength=len(keys))[label] > 1
        cell = mix(mix(keys.view(np.uint64)) ^ nodes[label].view(np.uint64))[many]
        return pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(nodes[many])], names=["bucket", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not len(b):
                continue
            now = [np.asarray(b["key"]), np.asarray(b["node"]), np.stack([np.asarray(b[c]).view(np.uint64) for c in _FPS], axis=1)]
            last = int(np.searchsorted(now[0], now[0][-1], side="left"))
            if held and (last or now[0][0] != held[0][0][0]):
                # the held run ends here: whole runs are searched, the last one is held
                yield found(*(np.concatenate(x) for x in zip(*held, [x[:last] for x in now])))
                held = []
            elif last:
                yield found(*(x[:last] for x in now))
            held.append([x[last:] for x in now])
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held)))

    return rows.mapInArrow(run, "bucket long, node long")


def linked(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at the similarity or above, as pairs of places."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, sets = size[order], [sets[i] for i in order]
    left = np.ones(len(sets), bool)
    out = []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front:
            x = front.pop()
            # a set of less than similarity times the other's size cannot reach it
            lo = np.searchsorted(size, math.floor(size[x] * similarity), side="left")
            hi = np.searchsorted(size, math.ceil(size[x] / similarity), side="right")
            rest = lo + np.flatnonzero(left[lo:hi])
            for at in range(0, len(rest), 256):
                some = rest[at : at + 256]
                both = _common(sets[x], [sets[i] for i in some])
                whole = size[some] + size[x] - both
                near = some[(both >= similarity * whole - 1e-9)]
                left[near] = False
                out += [(int(order[x]), int(order[y])) for y in near]
                front += near.tolist()
    return out


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of ``one`` each of the others has."""
    flat = np.concatenate(others)
    if not len(one) or not len(flat):
        return np.zeros(len(others), np.int64)
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    total = np.concatenate([[0], np.cumsum(one[place] == flat)])
    ends = np.cumsum([len(s) for s in others])
    return total[ends] - total[ends - np.array([len(s) for s in others])]


def _arrays(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def alike(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Is the Jaccard similarity of two sets at least so much?"""
    both = int(_common(one, [two])[0])
    return both >= similarity * (len(one) + len(two) - both) - 1e-9


def _head_links(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(src, dst) of rows (head, part, node, text) in runs of one head and part, the head's own row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for b in batches:
            out = []
            for h, node, t in zip(b["head"].to_pylist(), b["node"].to_pylist(), b["text"].cast(pa.binary())):
                found = shingles(t.as_py(), width)
                if h == node:
                    head, own = h, found
                elif h == head and alike(own, found, similarity):
                    out.append((h, node))
            yield _arrays(out)

    return rows.mapInArrow(run, "src long, dst long")


def _block_links(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(src, dst), groups that a link joins, of rows (key, group, text) in runs of equal keys."""

    def found(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        pairs = {tuple(sorted((held[i][0], held[j][0]))) for i, j in linked([x for _, x in held], similarity)}
        return _arrays([(a, b) for a, b in pairs if a != b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for key, group, t in zip(b["key"].to_pylist(), b["group"].to_pylist(), b["text"].cast(pa.binary())):
                if key != now and held:
                    yield found(held)
                    held = []
                now = key
                held.append((group, shingles(t.as_py(), width)))
        if held:
            yield found(held)

    return rows.mapInArrow(run, "src long, dst long")


def _sized(rows: DataFrame, block_bytes: int) -> DataFrame:
    """unit, its largest group (main), blocks of that group and of the rest, and the rows dealt, of rows (unit, bytes, group)."""
    each = rows.groupBy("unit", "group").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    whole = each.groupBy("unit").agg(F.max(F.struct("n", "group", "b")).alias("top"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    # a pair of blocks is to have no more than what is one block alone
    blocks = lambda n, b: F.ceil(2 * F.greatest(b / block_bytes, n / BLOCK_ROWS)).cast("int")
    n, b = F.col("n") - F.col("top.n"), F.col("b") - F.col("top.b")
    fits = blocks(F.col("n"), F.col("b")) <= 2
    sized = whole.select("unit", "top", "n", F.when(fits, 0).otherwise(blocks(F.col("top.n"), F.col("top.b"))).alias("wide"), F.when(fits, 1).otherwise(blocks(n, b)).alias("rest"))
    dealt = F.when(F.col("wide") == 0, F.col("n")).otherwise(F.col("top.n") * F.col("rest") + n * (F.col("rest") + F.col("wide")))
    return sized.select("unit", F.col("top.group").alias("main"), "wide", "rest", dealt.alias("dealt"))


def _met(held: DataFrame, block_bytes: int) -> DataFrame:
    """key (unit, i, j), node and group: a row for each pair of blocks that a text is in, of rows (bucket, web, node, bytes, group).

    Units are webs, or the buckets of a web where these are fewer rows.
    """
    texts = held.dropDuplicates(["node"]).select(F.col("web").alias("unit"), "node", "bytes", "group")
    cells = held.withColumnRenamed("bucket", "unit")
    webs, buckets = settle(_sized(texts, block_bytes)), settle(_sized(cells, block_bytes))
    apart = buckets.join(held.select(F.col("bucket").alias("unit"), "web").distinct(), "unit").groupBy("web").agg(F.sum("dealt").alias("apart"))
    apart = settle(webs.join(apart.withColumnRenamed("web", "unit"), "unit").filter("apart < dealt").select("unit"))
    cells = cells.join(apart.withColumnRenamed("unit", "web"), "web", "left_semi").select("unit", "node", "group").join(buckets, "unit")
    rows = texts.select("unit", "node", "group").join(webs.join(apart, "unit", "left_anti"), "unit").unionByName(cells)
    # the rest is in blocks from 0 on and meets all blocks; the main group's come after, and meet the rest only
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    at = F.when((F.col("wide") > 0) & (F.col("group") == F.col("main")), F.col("rest") + place(F.greatest("wide", F.lit(1)))).otherwise(place(F.col("rest")))
    last = F.when(F.col("at") >= F.col("rest"), F.col("rest")).otherwise(F.col("rest") + F.col("wide")) - 1
    rows = rows.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select(F.struct("unit", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")).alias("key"), "node", "group")


def groups(docs: DataFrame, width: int, similarity: float, deal: int = DEAL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, component) of nodes that are near copies of others, over rows (node, text).

    Rows of one node have one text; the component is its smallest node.
    """
    spark = docs.sparkSession
    signed = settle(_signed(docs, width).dropDuplicates(["node"]))
    dealt = _dealt(signed, block_bits(signed.count()), similarity)
    cells = settle(_cells(dealt.repartition(parts(spark), "key").sortWithinPartitions("key", "node"), similarity))
    rows = settle(cells.join(signed.select("node", "bytes"), "node"))
    heads = settle(rows.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("a"), F.sum(F.xxhash64(F.col("node") + 1) % (1 << 31)).alias("b")).filter("members > 1"))
    members = settle(rows.join(heads.select("bucket", "head"), "bucket"))
    pairs = settle(members.filter("node != head").select("head", "node").distinct())
    # a head's text goes along once for each part of its members
    sizes = settle(pairs.groupBy("head").agg(F.ceil(F.count("*") / deal).cast("int").alias("parts")))
    dealt = settle(pairs.join(sizes, "head").select("head", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    own = sizes.select("head", F.col("head").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # copies meet before the exchange, so that a text of many rows is not hot in the join
    one = docs.dropDuplicates(["node"])
    texts = one.join(dealt.select("node").union(own.select("node")).distinct(), "node", "left_semi")
    sent = dealt.unionByName(own).join(texts, "node").select("head", "part", "node", "text")
    ordered = sent.repartition(parts(spark), "head", "part").sortWithinPartitions("head", "part", F.col("node") != F.col("head"))
    links = settle(_head_links(ordered, width, similarity))
    first = connected_components(links)
    # buckets of three or more whose other members are in one group by now have no pair left
    known = settle(members.filter("node != head").join(first, "node", "left").select("bucket", "node", "bytes", F.coalesce("component", "node").alias("group")))
    open_ = known.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low != high")
    # bands often hold the same members: one bucket of them is enough
    open_ = settle(heads.join(open_, "bucket").dropDuplicates(["members", "a", "b"]).select("bucket", "low"))
    if open_.isEmpty():
        return first
    webs = connected_components(settle(known.join(open_, "bucket").select(F.col("low").alias("src"), F.col("group").alias("dst")).distinct()))
    open_ = settle(open_.join(webs.select(F.col("node").alias("low"), F.col("component").alias("web")), "low").select("bucket", "web"))
    held = settle(known.join(open_, "bucket").select("bucket", "web", "node", "bytes", "group"))
    met = settle(_met(held, block_bytes))
    texts = one.join(met.select("node").distinct(), "node", "left_semi")
    sent = met.join(texts, "node").select(F.concat_ws(":", "key.unit", "key.i", "key.j").alias("key"), "group", "text")
    more = settle(_block_links(sent.repartition(parts(spark), "key").sortWithinPartitions("key"), width, similarity))
    # what is known goes as groups, so that a block adds no link within one
    return connected_components(first.select(F.col("component").alias("src"), F.col("node").alias("dst")).union(more))
