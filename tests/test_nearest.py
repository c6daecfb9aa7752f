"""Search by blocks against the same search pair by pair."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import measure
from quarry.operators import nearest as N
from quarry.operators import vector as V
from quarry.operators.lexical import top_k


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, ties, nulls, other dimensions, values that are not finite, and very large ones."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 6)), 1)
    x[40:90] = x[7]
    v = [[float(c) for c in r] for r in x]
    v[3], v[4], v[5], v[6] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], []
    v[10], v[11], v[12], v[13] = [math.nan] * 6, [math.inf] + [0.0] * 5, [-math.inf, 1.0, 0.0, 0.0, 0.0, 2.0], [1e200, -1e200, 0.0, 0.0, 0.0, 0.0]
    v[14] = [0.0] * 6
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(v)], "item long, v array<double>").repartition(5).cache()
    q = rows.filter("item % 4 = 0 or item < 20").select(F.col("item").alias("query_id"), "v")
    return rows, q


def told(df, *names):
    text = lambda x: x if not isinstance(x, float) else "nan" if math.isnan(x) else x + 0.0
    return sorted((tuple(text(x) for x in r) for r in df.select(*names).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("metric", ["dot", "l1", "l2"])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_same_as_pair_by_pair(metric, k, odd):
    rows, q = odd
    want = V.paired(rows, q).select("query_id", "item", measure(F.col("v"), F.col("q"), metric).alias("score"))
    names = ("query_id", "rank", "item", "score")
    got = V.knn(rows, q, k, metric)
    assert told(got, *names) == told(top_k(want, k, tie="item"), *names)


def test_blocks_meet_in_every_order(odd, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 16)
    monkeypatch.setattr(N, "FEW_QUERIES", 9)
    rows, q = odd
    want = V.paired(rows, q).select("query_id", "item", measure(F.col("v"), F.col("q"), "l2").alias("score"))
    names = ("query_id", "rank", "item", "score")
    assert told(V.knn(rows, q, 5, "l2"), *names) == told(top_k(want, 5, tie="item"), *names)


def test_last_place_is_rounded_as_spark_does(spark):
    x = np.random.default_rng(1).normal(size=2000) * 10.0 ** np.random.default_rng(2).integers(-9, 12, 2000)
    x = np.concatenate([x, [0.0000000005, -0.0000000015, 0.1234567895, 1.0000000005, 2.5e-9, math.inf, -math.inf, 4194304.0000000005]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert N.rounded(x).tolist() == [r[0] for r in df.select(F.round("x", 9)).collect()]


def test_tags_and_shared_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * (rng.random((300, 4)) < 0.4)
    tags = rng.integers(0, 5, (300, 3))
    rows = spark.createDataFrame([(i, v.tolist(), t.tolist() if i % 9 else None) for i, (v, t) in enumerate(zip(x, tags))], "item long, v array<double>, tags array<int>")
    q = rows.filter("item % 10 = 1").withColumnRenamed("item", "query_id")

    def best(may):
        out = {}
        for a in range(1, 300, 10):
            pairs = sorted((-round(float(x[a] @ x[b]), 9), b) for b in range(300) if may(a, b))[:4]
            out[a] = [b for _, b in pairs]
        return out

    def got(df):
        out = {a: [] for a in range(1, 300, 10)}
        for r in sorted(top_k(df, 4, tie="item").collect(), key=lambda r: r["rank"]):
            out[r["query_id"]].append(r["item"])
        return out

    known = lambda i: i % 9 != 0
    assert got(N.nearest(rows, q, 4)) == best(lambda a, b: known(a) and known(b) and (tags[a] == tags[b]).any())
    one = rows.withColumn("tags", F.slice("tags", 1, 1))
    assert got(N.nearest(one, q, 4)) == best(lambda a, b: known(a) and known(b) and (tags[a] == tags[b, 0]).any())
    assert got(N.nearest(rows.drop("tags"), q.drop("tags"), 4, together=True)) == best(lambda a, b: ((x[a] != 0) & (x[b] != 0)).any())


def test_sparse_postings_and_vectors_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    w = [(i, f"t{t}", float(rng.random() + 0.1)) for i in range(150) for t in rng.choice(12, int(rng.integers(1, 4)), replace=False)]
    weights = spark.createDataFrame(w, "item long, term string, weight double")
    q = weights.filter("item % 7 = 0").selectExpr("item as query_id", "term", "weight as qw")
    names = ("query_id", "rank", "item")
    vectors = told(V.sparse_search(weights, q, 60), *names)
    assert "CartesianProduct" in plan_of(V.sparse_search(weights, q, 60))
    monkeypatch.setattr(V, "DENSE_TERMS", 0)
    assert vectors == told(V.sparse_search(weights, q, 60), *names)


def test_tokens_by_blocks_and_pair_by_pair(spark):
    rng = np.random.default_rng(9)
    toks = [rng.normal(size=(int(rng.integers(1, 4)), 3)).round(2).tolist() for _ in range(60)]
    toks[5], toks[6], toks[7], toks[8], toks[9] = None, [], [[1.0, None, 2.0], [1.0, 1.0, 1.0]], [[1.0, 2.0]], [[math.nan, 1.0, 1.0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(toks)], "item long, toks array<array<double>>")
    q = docs.filter("item % 6 = 0 or item < 10").select(F.col("item").alias("query_id"), F.col("toks").alias("qtoks"))
    by_name = lambda df, n: df.select(F.concat(F.lit("d"), "item").alias("item"), "toks") if n == "item" else df.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "qtoks")
    for digits in (None, 6):
        want = V.maxsim(by_name(docs, "item"), by_name(q, "query_id"), digits)  # ids that are no numbers go pair by pair
        want = want.select(F.substring("query_id", 2, 9).cast("long").alias("query_id"), F.substring("item", 2, 9).cast("long").alias("item"), "score")
        got = told(V.maxsim(docs, q, digits), "query_id", "item", "score")
        assert len(got) == 60 * q.count() and got == told(want, "query_id", "item", "score")


@pytest.mark.parametrize("name", ["adc_rerank", "kd_box_pruned", "knn_cosine", "knn_dot", "knn_l1", "knn_l2", "knn_post9", "lsh_search", "maxsim_scores", "native_refined", "pq_adc", "ivf_flat", "knn_post3", "sparse_search", "label_recall", "plan_quality"])
def test_no_pair_of_rows_is_joined(name, spark, sf):
    """Blocks of vectors meet, not vectors."""
    from quarry.catalog import QUERIES

    plan = plan_of(QUERIES[name](spark, sf))
    joins = [x for x in plan[plan.index("== Optimized Logical Plan ==") : plan.index("== Physical Plan ==")].splitlines() if "Join Cross" in x or "Join Inner" in x and "query_id" in x]
    assert "CartesianProduct" in plan, json.dumps(joins)
