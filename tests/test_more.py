"""Operators against hand values and brute force, where SQL does not reach."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.catalog import QUERIES
from quarry.operators import execution as X
from quarry.operators import generations as G
from quarry.operators import lexical as L
from quarry.operators import metadata as M
from quarry.operators import queries as R
from quarry.operators import storage as S
from quarry.operators import training as T
from quarry.operators import vector as V
from quarry.plans import lexical as PL
from quarry.sources import generators as N


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(1)
    m, q, p = rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=(5, 3))
    for normalize in (False, True):
        loss, grad = T.contrastive_gradient(m, q, p, 2, 0.7, normalize)
        assert loss > 0 and np.allclose(grad, T.finite_differences(m, q, p, 2, temperature=0.7, normalize=normalize), atol=1e-5)
    with pytest.raises(ValueError):
        T.contrastive_gradient(m, q, p, 9)
    with pytest.raises(ValueError):
        T.contrastive_gradient(np.zeros((3, 4)), q, p, 0, normalize=True)


def test_adapter_learns_a_rotation(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(40, 6))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    q = p.copy()
    q[:, [0, 1]] = q[:, [1, 0]]
    a, b, loss = T.train_adapter(q[:30], p, np.arange(30), steps=300, rate=0.02, held=(q[30:], np.arange(30, 40)))
    start = T.train_adapter(q[:30], p, np.arange(30), steps=0, held=(q[30:], np.arange(30, 40)))[2]
    assert loss < 0.7 * start
    df = spark.createDataFrame([([float(x) for x in q[0]],)], "v array<double>")
    got = df.select(T.adapted(F.col("v"), a.tolist(), b.tolist()).alias("v")).first()["v"]
    y = q[0] + b @ (a @ q[0])
    assert np.allclose(got, y / np.linalg.norm(y))


def test_beams_against_a_plain_cache():
    assert S.beam([3, 1, 3, 2, 2, 4], [1, 2], 2) == ([False, True, False, True, True, False], [3, 4], [1, 2], [3, 4])
    with pytest.raises(ValueError):
        S.beam([1], [1, 1], 2)
    rng = np.random.default_rng(3)
    cache = []
    for _ in range(200):
        pages = rng.integers(0, 9, 6).tolist()
        hits, read, gone, after = S.beam(pages, cache, 3)
        assert hits == [p in cache for p in pages] and len(read) == len(set(read)) and set(after) <= set(cache) | set(read) and len(after) <= 3
        assert set(gone) == (set(cache) | set(read)) - set(after)
        cache = after


def test_replay_goes_on_over_batches(spark):
    rows = [(t, b, [(t + b * k) % 7 for k in range(4)]) for t in range(5) for b in range(30)]
    got = {(r["trace"], r["beam"]): (r["hits"], r["read"], r["evicted"]) for r in S.replay(spark.createDataFrame(rows, "trace long, beam long, pages array<long>"), 3).collect()}
    for t in range(5):
        cache = []
        for _, b, pages in [r for r in rows if r[0] == t]:
            hits, read, gone, cache = S.beam(pages, cache, 3)
            assert got[t, b] == (sum(hits), len(read), len(gone))


def test_graph_snapshot_and_deletion():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8))
    g = V.Graph(6, 40)
    for i, v in enumerate(x):
        g.add(i, v)
    again = V.Graph.restored(json.loads(json.dumps(g.snapshot())), g.digest())
    assert again.search(x[5], 3, 40) == g.search(x[5], 3, 40) and again.payload_bytes()["vectors"] == 120 * 8 * 4
    with pytest.raises(ValueError):
        V.Graph.restored(g.snapshot(), "another")
    broken = g.snapshot()
    broken["layers"][0][0][1] = [10_000]
    with pytest.raises(ValueError):
        V.Graph.restored(broken)
    for i in [g.items[g.entry], 5, 6]:
        g.delete(i)
    walked = []
    rows = g.rows
    g.rows = type("Seen", (list,), {"__getitem__": lambda self, n: walked.append(n) or list.__getitem__(self, n)})(rows)
    found = g.search(x[5], 5, 60)
    assert found and not {n for _, n in found} & g.blocked and not {g.items[n] for n in walked} & g.blocked
    one = V.Graph()
    one.add(1, x[0])
    one.delete(1)
    assert one.search(x[0], 3, 10) == []


def test_median_cells_prune_and_take_any_k(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 3)) + 20 * c for c in np.eye(3)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, v array<double>")
    q = spark.createDataFrame([(0, x[0].tolist()), (1, x[100].tolist())], "query_id long, v array<double>")
    for k, table in ((5, rows), (150, rows), (5, rows.limit(3)), (1, rows.limit(0))):
        want = V.knn(table, q, k, "l2").select("query_id", "item", "rank").collect()
        assert sorted(V.box_pruned(table, q, k).select("query_id", "item", "rank").collect()) == sorted(want)
    splits = V.median_splits(rows, 8)
    assert len(splits) == 7
    sizes = [r["count"] for r in rows.groupBy(V.cell_of(F.col("v"), splits).alias("c")).count().collect()]
    assert len(sizes) == 8 and min(sizes) >= 15


def test_pruning_scores_fewer_segments(spark, sf):
    docs, q = PL.docs(spark, sf), PL.questions(spark, sf)
    every = L.impacts(docs, q).join(q, "term").select("query_id", "seg").distinct().count()
    few = L.pruned(docs, q, 1).select("query_id", "seg").distinct().count()
    assert few < every


def test_indexes_find_nine_of_ten(spark, sf):
    found = {r["name"]: r["recall"] for r in QUERIES["ann_recall"](spark, sf).collect()}
    assert len(found) == 4 and min(found.values()) >= 0.9, found


def test_admission_by_hand(spark):
    rows = [
        (1, 1, "refund of ORD-12 please", "a", "a"), (1, 2, "REFUND OF ord-12 for Anna", "a", "a"), (1, 3, "Refund of ORD-12 Please", "b", "a"), (1, 4, "where is ORD-12", "a", "a"), (1, 5, "WHERE IS ORD-12", "a", "a"), (1, 6, "status of ORD-12", "a", "a"), (1, 7, "ORD-12 again", "a", "a"),
        (2, 1, "word " * 100, "a", "a"), (2, 2, "few", None, "a"),
    ]
    df = spark.createDataFrame([(*r, "refund of ORD-12" if r[0] == 1 else "word " * 30) for r in rows], "query_id long, n int, text string, lock string, expected string, original string")
    got = {(r["query_id"], r["n"]): r["reason"] for r in R.admit(df).collect()}
    assert got == {(1, 1): "accepted", (1, 2): "protected_atom", (1, 3): "anchor", (1, 4): "accepted", (1, 5): "duplicate", (1, 6): "branch_budget", (1, 7): "branch_budget", (2, 1): "word_budget", (2, 2): "anchor"}


def test_metadata_fixtures(spark):
    got = {r["record_id"]: r["problem"] for r in M.ingested(N.fixtures(spark)["metadata"], "1", "1").collect()}
    assert got == {"r1": None, "r2": "identity", "r3": "repeated_role"}


def test_versions_refuse_contradictions(spark):
    events = N.fixtures(spark)["events"].withColumn("event_id", F.concat_ws("-", "source", "revision")).withColumn("digest", F.sha2("payload", 256))
    caps = G.capsules(events.filter("revision = 1"), events.filter("revision = 2"))
    with pytest.raises(ValueError):
        G.capsules(events, events)
    vectors = caps.select("key", F.array(F.lit(0.6), F.lit(0.8)).alias("v"))
    assert G.materialized(events, caps, vectors, 2).count() == 3
    for bad in (vectors.filter("key != '1@1'"), vectors.withColumn("v", F.array(F.lit(1.0), F.lit(1.0)))):
        with pytest.raises(ValueError):
            G.materialized(events, caps, bad, 2)
    state = G.state_payload(events)
    assert G.restored(state).count() == 4
    with pytest.raises(ValueError):
        G.restored(state.withColumn("is_head", F.col("revision") == 1))


def test_traces_are_refused_or_kept_without_rows(spark):
    roster = spark.createDataFrame([(1,), (2,)], "item long")
    c = X.Collector(spark, "w", {"corpus": "1"}, roster)
    ok = spark.createDataFrame([(1, 0.5), (2, 0.25)], "item long, score double")
    assert c.execute("q1", "lexical", lambda: ok).count() == 2
    for bad in ([(3, 1.0)], [(1, float("nan"))]):
        with pytest.raises(ValueError):
            c.execute("q2", "dense", lambda bad=bad: spark.createDataFrame(bad, "item long, score double"))
    rows = {(r["query_id"], r["status"], r["reason"], r["n"]) for r in c.table().collect()}
    assert rows == {("q1", "ok", None, 2), ("q2", "failed", "ValueError", 0)}
    with pytest.raises(PermissionError):
        X.gated_context(spark.createDataFrame([(1, 5, 1)], "query_id long, item long, rank int"), roster, roster.withColumn("size", F.lit(1)), 10)


def test_lookups_half_there(spark):
    r = N.lookup_experiment(spark, (32,), 16, 1).collect()
    assert {x["way"]: x["hits"] for x in r}["join"] == 8
    assert N.timing_summary([3.0, 1.0, 2.0]) == {"n": 3, "p50": 2.0, "p95": 3.0} and N.timing_summary([]) == {"n": 0}


def test_blocks_of_pages_and_notes():
    from quarry.operators.segments import parse_html, parse_markdown

    page = "<head><title>t</title></head>loose <b>text</b><h1>A</h1><p>one<br>two <i>x</i></p><div aria-hidden=true>no<p>no</p></div><table><tr><th>k</th><th>v</th></tr><tr><td>x</td><td>1</td></tr></table><section><nav>no</section><p>after</p>"
    assert parse_html(page) == [("prose", "loose text"), ("heading", "A"), ("prose", "one two x"), ("table_header", "k | v"), ("table_row", "k=x; v=1"), ("prose", "after")]
    for bad in ("loose", "<p>a</div></p>", "<table><tr><td>a</td></tr></table>", "<p>a<p>b</p></p>"):
        with pytest.raises(ValueError):
            parse_html(bad, strict=True)
    assert parse_html(None) == [] and parse_html("<p hidden>x</p>", strict=True) == []
    assert parse_markdown("# A\n#tag line\nmore\n\n```\n# code\n```\n####### seven") == [("heading", "A"), ("prose", "#tag line more"), ("code", "# code"), ("prose", "####### seven")]
    assert parse_markdown("```\nx") == [("code", "x")] and parse_markdown(None) == []
    with pytest.raises(ValueError):
        parse_markdown("```\nx", strict=True)
