"""Steps whose work must not grow with the square of the input."""

import random

import numpy as np

from quarry.catalog import QUERIES
from quarry.operators import fields as D
from quarry.operators import metadata as M
from quarry.operators import prompts as P
from quarry.operators import vector as V


def test_eligible_items_of_every_query_are_counted_once(spark, sf):
    of = lambda *rows: spark.createDataFrame(rows, "query_id long, item long")
    ranked, exact = of((0, 1), (0, 2), (1, 9), (2, 3)), of((0, 1), (1, 4), (2, 3))
    items = spark.createDataFrame([(1,), (3,), (4,), (4,)], "item long")
    each = items.crossJoin(spark.createDataFrame([(0,), (1,), (2,)], "query_id long"))
    got, want = (sorted(map(tuple, M.plan_quality(ranked, exact, e, exact, 2).collect())) for e in (items, each))
    assert got == want and len(got) == 3
    plan = QUERIES["plan_quality"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    crosses = [x for x in plan.splitlines() if "Join Cross" in x and "shuffle_replicate_nl" not in x]
    assert len(crosses) == 1  # the row of the total


def test_flat_overlap_searches_each_set_of_words_once(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 6))) or None) for i in range(200)], "doc_id long, text string")
    urls = [(i, "http://x.y/" + "/".join(rng.choices(words, k=2)) + f"/{i}") for i in range(300)]
    q = spark.createDataFrame([*urls, (300, None), (301, "no-word-of-theirs")], "query_id long, text string")
    of = lambda t: set((t or "").split())
    held = {r["doc_id"]: of(r["text"]) for r in docs.collect()}
    want = set()
    for i, t in urls:
        asked = set(t[11:].split("/"))
        scores = sorted((-len(asked & have), s) for s, have in held.items() if asked & have)[:3]
        want |= {(i, s, -n, r + 1) for r, (n, s) in enumerate(scores)}
    searched = []
    monkeypatch.setattr(D, "sparse_search", lambda rows, ask, k, f=D.sparse_search: searched.append(ask.select("query_id").distinct().count()) or f(rows, ask, k))
    assert {tuple(r) for r in D.flat_overlap(docs, q, 3).select("query_id", "seg", "score", "rank").collect()} == want
    assert searched[0] <= 45


def test_walks_in_step_are_those_of_one_query():
    x = np.random.default_rng(6).normal(size=(300, 8))
    g = V.Graph(6, 40)
    for i, v in enumerate(x):
        g.add(i * 3, v)
    for i in (0, 9, g.items[g.entry]):
        g.delete(i)
    q = np.concatenate([x[::7], x[:9] + 0.1])
    one = [(i, n) for i, v in enumerate(q) for _, n in g.search(v, 5, 30)]
    a, far, item = g.search_many(q, 5, 30, 1)
    assert list(zip(a.tolist(), item.tolist())) == one
    assert np.allclose(far, ((x[item // 3] - q[a]) ** 2).sum(axis=1))
    a, _, item = g.search_many(q, 5, 30)
    assert len(set(one) & set(zip(a.tolist(), item.tolist()))) >= 0.95 * len(one)
    few = V.Graph()
    assert len(few.search_many(q, 5, 30)[0]) == 0
    few.add(1, x[0])
    assert few.search_many(q[:2], 5, 30)[2].tolist() == [1, 1]


def test_shards_hold_bounded_graphs(spark):
    """More shuffle partitions are no more graphs, and a large shard is searched by several."""
    x = np.random.default_rng(7).normal(size=(600, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, v array<double>")
    q = rows.filter("item % 20 = 0").withColumnRenamed("item", "query_id")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = V.hnsw(rows, q, 5)
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString() and ", 8), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
        near = V.knn(rows, q, 5, "l2")
        for got in (found, V.hnsw(rows, q, 5, 2, rows_per_shard=100)):
            assert V.recall(got, near, 5).selectExpr("avg(recall)").first()[0] >= 0.9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_positions_are_gathered_in_each_task(spark):
    """The same places as by a row a character, and places far apart are not remembered together."""
    texts = ["a b\tc\n\x0b\x0c\r d", "é  x😀y", "", None, "   ", "z" * 50]
    units = spark.createDataFrame([(s, i * 7 + far, t) for far in (0, 9000) for i, t in enumerate(texts) for s in ("p", "q", "also p")], "source string, start int, text string").repartition(4)
    alias = spark.createDataFrame([("also p", "p")], "alias string, source string")
    want = {}
    for r in units.collect():
        for i, c in enumerate(r["text"] or ""):
            if c not in " \t\n\x0b\x0c\r":
                want.setdefault({"also p": "p"}.get(r["source"], r["source"]), set()).add(r["start"] + i)
    assert {r["source"]: r["n"] for r in P.positions(units, alias).collect()} == {s: len(p) for s, p in want.items()}
    rows = units.selectExpr("source", "cast(start as long) as start", "text").filter("source = 'q'")
    for few in (1, 40, 1 << 20):
        assert {r["p"] for r in P.held(rows, few).collect()} == want["q"]
    one = spark.createDataFrame([("s", 0, "abc")] * 1000, "source string, start long, text string").coalesce(1)
    assert P.held(one).count() == 3


def test_pages_are_parsed_a_slice_at_a_time(spark):
    import pyarrow as pa

    from quarry.functions.text import cut

    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 400, None, "y" * 700, "z" * 5000, "", "w"])], names=["i", "t"])
    assert [p["i"].to_pylist() for p in cut(b, "t", 1000)] == [[0, 1], [2], [3], [4, 5]]
    assert "MapInArrow" in QUERIES["html_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
