"""Pages on disk behind a cache of bounded size, as a fold over beams."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beam(pages: list[int], cache: list[int], capacity: int) -> tuple[list[bool], list[int], list[int], list[int]]:
    """(hits, pages read, pages evicted, cache after) of one beam of page ids; the cache lists the oldest first.

    Whether a page is there is settled as the beam begins; a page that is missed twice is read once.
    """
    if capacity < 1 or len(cache) > capacity or len(set(cache)) < len(cache):
        raise ValueError("not a state of such a cache")
    held = OrderedDict.fromkeys(cache)
    hits = [p in held for p in pages]
    for p, hit in zip(pages, hits):
        if hit:
            held.move_to_end(p)
    read = list(dict.fromkeys(p for p, hit in zip(pages, hits) if not hit))
    gone = []
    for p in read:
        held[p] = None
        if len(held) > capacity:
            gone.append(held.popitem(last=False)[0])
    return hits, read, gone, list(held)


def replay(beams: DataFrame, capacity: int) -> DataFrame:
    """(trace, beam, hits, read, evicted) of beams (trace, beam, pages): one cache a trace, its beams in order.

    What a beam finds depends on the ones before it, so a trace is a fold; traces are apart, and
    a task holds one trace's cache of ``capacity`` pages, never its beams.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, []
        for frame in frames:
            out = []
            for trace, n, pages in frame.itertuples(index=False):
                if trace != now:
                    now, cache = trace, []
                hits, read, gone, cache = beam(list(pages), cache, capacity)
                out.append((trace, n, sum(hits), len(read), len(gone)))
            yield pd.DataFrame(out, columns=["trace", "beam", "hits", "read", "evicted"])

    rows = beams.select(F.col("trace").cast("long"), F.col("beam").cast("long"), F.col("pages").cast("array<long>"))
    n = int(beams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "trace").sortWithinPartitions("trace", "beam").mapInPandas(run, "trace long, beam long, hits long, read long, evicted long")
