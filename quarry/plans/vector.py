"""Vector queries.  Questions: every vector whose id is divisible by 20, against all."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import vector as X
from quarry.operators.lexical import small, top_k
from quarry.sources.readers import table

Q, O = {}, {}


def plan(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def rows(spark, d):
    return X.items(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def asked(spark, d):
    return rows(spark, d).filter("item % 20 = 0").select(F.col("item").alias("query_id"), "v")


def scored(df):
    return df.select("query_id", F.col("item").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


BASE = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 20 = 0)"""
DOT = "list_dot_product(v, q)"
COS = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"
L2 = "list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
L1 = "list_sum(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2])))"


def nearest(score: str, k: int, where: str = "true", more: str = "") -> str:
    return f"""{BASE}{more}, s AS (SELECT query_id, vec_id, label, {score} AS score FROM e, q WHERE {where})
SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""


@plan(nearest(COS, 10))
def knn_cosine(spark, d):
    return scored(X.knn(rows(spark, d), asked(spark, d), 10))


@plan(nearest(DOT, 10))
def knn_dot(spark, d):
    return scored(X.knn(rows(spark, d), asked(spark, d), 10, "dot"))


@plan(nearest(f"0 - sqrt({L2})", 10))
def knn_l2(spark, d):
    return scored(X.knn(rows(spark, d), asked(spark, d), 10, "l2"))


@plan(nearest(f"0 - {L1}", 10))
def knn_l1(spark, d):
    return scored(X.knn(rows(spark, d), asked(spark, d), 10, "l1"))


@plan(nearest(COS, 2, "label = 3"))
def knn_prefilter(spark, d):
    return scored(X.prefiltered(rows(spark, d), asked(spark, d), F.col("label") == 3, 2))


def post(depth: int) -> str:
    return f"""{BASE}, s AS (SELECT query_id, vec_id, label, {COS} AS score FROM e, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM s)
SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM t WHERE r <= {depth} AND label < 5) WHERE rank <= 2"""


@plan(post(3))
def knn_post3(spark, d):
    return scored(X.postfiltered(rows(spark, d), asked(spark, d), F.col("label") < 5, 2, 3))


@plan(post(9))
def knn_post9(spark, d):
    return scored(X.postfiltered(rows(spark, d), asked(spark, d), F.col("label") < 5, 2, 9))


@plan(nearest(f"0 - {L2}", 2))
def native_refined(spark, d):
    return scored(X.refined(rows(spark, d), asked(spark, d), 2, 64))


@plan(nearest(f"0 - {L2}", 5))
def kd_box_pruned(spark, d):
    return scored(X.box_pruned(rows(spark, d), asked(spark, d), 5))


def _planes(tables: int, bits: int) -> str:
    bit = lambda t, b: f"(CASE WHEN list_dot_product(v, {V.plane(t, b, 64)}) >= 0 THEN {1 << (bits - 1 - b)} ELSE 0 END)"
    return " UNION ALL ".join(f"SELECT vec_id, v, {t} AS t, {' + '.join(bit(t, b) for b in range(bits))} AS sig FROM e" for t in range(tables))


@plan(f"""{BASE}, k AS ({_planes(16, 3)}), s AS (SELECT DISTINCT b.vec_id AS query_id, a.vec_id, a.v, b.v AS q FROM k a JOIN k b ON a.t = b.t AND a.sig = b.sig WHERE b.vec_id % 20 = 0), c AS (SELECT query_id, vec_id, {COS} AS score FROM s)
SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM c) WHERE rank <= 5""")
def lsh_search(spark, d):
    return scored(X.lsh(rows(spark, d), asked(spark, d), 5, 16, 3))


def lists(spark, d):
    """Eight coarse centroids: the first eight vectors, so that any engine has them."""
    return rows(spark, d).filter("item < 8").select(F.col("item").cast("int").alias("list_id"), F.col("v").alias("c"))


ASSIGN = f"""{BASE}, c AS (SELECT vec_id AS list_id, v AS q FROM e WHERE vec_id < 8), d2 AS (SELECT vec_id, v, list_id, round({L2}, 12) AS d2 FROM e, c), a AS (SELECT vec_id, any_value(v) AS v, arg_min(list_id, d2 + list_id * 1e-13) AS list_id, min(d2) AS d2 FROM d2 GROUP BY 1)"""


@plan(f"{ASSIGN} SELECT list_id::INTEGER AS list_id, count(*)::BIGINT AS n, round(sum(d2), 6) AS error FROM a GROUP BY 1")
def kmeans_assign(spark, d):
    return X.assign(rows(spark, d), lists(spark, d)).groupBy("list_id").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 6).alias("error"))


@plan(f"""{ASSIGN}, p AS (SELECT query_id, list_id, q FROM (SELECT query_id, list_id, row_number() OVER (PARTITION BY query_id ORDER BY d2, list_id) AS r FROM (SELECT vec_id AS query_id, list_id, d2 FROM d2 WHERE vec_id % 20 = 0)) JOIN q USING (query_id) WHERE r <= 6),
s AS (SELECT query_id, vec_id, 0 - {L2} AS score FROM a JOIN p USING (list_id))
SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def ivf_flat(spark, d):
    return scored(X.ivf(rows(spark, d), asked(spark, d), lists(spark, d), 5, 6))


@plan()
def ann_recall(spark, d):
    """(name, recall): the mean share of the exact ten nearest that each approximate index finds."""
    r, q = rows(spark, d), asked(spark, d)
    near, cosine = X.knn(r, q, 10, "l2"), X.knn(r, q, 10)
    coded = X.pq_encode(X.residuals(r, lists(spark, d)), books(spark, d))
    found = {"ivf": X.ivf(r, q, lists(spark, d), 10, 6), "hnsw": X.hnsw(r, q, 10), "adc_rerank": X.adc(coded, q, lists(spark, d), books(spark, d), 10, DEPTH)}
    out = X.recall(X.lsh(r, q, 10, 16, 3), cosine, 10).agg(F.lit("lsh").alias("name"), F.avg("recall").alias("recall"))
    for name, got in found.items():
        out = out.union(X.recall(got, near, 10).agg(F.lit(name).alias("name"), F.avg("recall").alias("recall")))
    return out


#: Candidates by code that exact distances decide among.
DEPTH = 400


_BOOKS: dict = {}


def books(spark, d) -> list:
    """Codebooks of eight subspaces, trained on a bounded sample of residuals."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BOOKS:
        some = spark.createDataFrame(X.sampled(rows(spark, d).select("item", "v"), 2000).collect(), "item long, v array<double>")
        rest = X.residuals(some, lists(spark, d)).select("item", F.col("r").alias("v"))
        _BOOKS[key] = [X.kmeans(rest.select("item", F.slice("v", 8 * s + 1, 8).alias("v")), 16, 4, 2000) for s in range(8)]
    return _BOOKS[key]


@plan()
def pq_adc(spark, d):
    codes = X.pq_encode(X.residuals(rows(spark, d), lists(spark, d)), books(spark, d))
    return scored(X.adc(codes, asked(spark, d), lists(spark, d), books(spark, d), 5))


@plan()
def adc_rerank(spark, d):
    codes = X.pq_encode(X.residuals(rows(spark, d), lists(spark, d)), books(spark, d))
    return scored(X.adc(codes, asked(spark, d), lists(spark, d), books(spark, d), 5, DEPTH))


@plan()
def hnsw_search(spark, d):
    return scored(X.hnsw(rows(spark, d), asked(spark, d), 5))


@plan(f"""WITH t AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings WHERE vec_id % 3 <> 0) SELECT label, i::INTEGER AS d, round(avg(x), 6) AS x FROM t GROUP BY 1, 2""")
def masked_mean_pool(spark, d):
    toks = rows(spark, d).select(F.col("label").alias("item"), F.col("item").alias("pos"), "v", (F.col("item") % 3 != 0).cast("int").alias("mask"))
    return X.mean_pool(toks).select(F.col("item").alias("label"), F.posexplode("v").alias("d", "x")).select("label", "d", F.round("x", 6).alias("x"))


@plan(f"""{BASE}, t AS (SELECT vec_id, i, v[16 * i + 1 : 16 * i + 16] AS v FROM e, range(4) r(i)), m AS (SELECT b.vec_id AS query_id, a.vec_id, b.i, max(list_dot_product(a.v, b.v)) AS s FROM t a, t b WHERE b.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, vec_id, round(sum(s), 6) AS score FROM m GROUP BY 1, 2""")
def maxsim_scores(spark, d):
    parts = lambda c: F.array(*(F.slice(c, 16 * i + 1, 16) for i in range(4)))
    docs = rows(spark, d).select("item", parts(F.col("v")).alias("toks"))
    ask = asked(spark, d).select("query_id", parts(F.col("v")).alias("qtoks"))
    return X.maxsim(docs, ask, 6).select("query_id", F.col("item").alias("vec_id"), "score")


SPARSE = f"""{BASE}, t AS (SELECT vec_id, unnest(range(64)) AS term, unnest(v) AS x FROM e), w AS (SELECT vec_id, term, ln(1 + x) AS w FROM t WHERE x > 0)"""


@plan(f"""{SPARSE}, s AS (SELECT b.vec_id AS query_id, a.vec_id, sum(a.w * b.w) AS score FROM w a JOIN w b USING (term) WHERE b.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def sparse_search(spark, d):
    weights = X.sparse_pool(rows(spark, d).select("item", F.posexplode("v").alias("term", "logit")))
    ask = weights.filter("item % 20 = 0").select(F.col("item").alias("query_id"), "term", F.col("weight").alias("qw"))
    return scored(X.sparse_search(weights, ask, 5))


@plan(f"""{BASE}, p AS (SELECT unnest(range(64)) AS i, unnest(v) AS x, label FROM e WHERE label IN (1, 2)), m AS (SELECT i, avg(x) FILTER (label = 1) AS p, avg(x) FILTER (label = 2) AS n FROM p GROUP BY 1),
z AS (SELECT i, x + 0.5 * p - 0.25 * n AS y FROM (SELECT unnest(range(64)) AS i, unnest(v) AS x FROM e WHERE vec_id = 0) JOIN m USING (i)) SELECT i::INTEGER AS d, round(y / sqrt(sum(y * y) OVER ()), 6) AS x FROM z""")
def rocchio(spark, d):
    r = rows(spark, d)
    mean = lambda label, name: X.mean_pool(r.filter(F.col("label") == label).select(F.lit(0).alias("item"), F.col("item").alias("pos"), "v", F.lit(1).alias("mask"))).select(F.col("v").alias(name))
    one = r.filter("item = 0").crossJoin(F.broadcast(mean(1, "p"))).crossJoin(F.broadcast(mean(2, "n")))
    return one.select(F.posexplode(X.rocchio(F.col("v"), F.col("p"), F.col("n"))).alias("d", "x")).select("d", F.round("x", 6).alias("x"))


@plan(f"""{BASE}, s AS (SELECT a.vec_id AS row, b.vec_id AS col, list_dot_product(a.v, b.v) / 0.1 AS z FROM e a JOIN e b ON a.vec_id // 16 = b.vec_id // 16)
SELECT row, round(ln(sum(exp(z))) - max(z) FILTER (row = col), 6) AS loss FROM s GROUP BY 1""")
def contrastive_loss(spark, d):
    """All vectors, in batches of sixteen ids."""
    r = rows(spark, d).withColumn("batch", F.floor(F.col("item") / 16))
    q = r.select("batch", F.col("item").alias("row"), F.col("v").alias("q"))
    pairs = r.join(q, "batch").select("row", F.col("item").alias("col"), V.dot(F.col("v"), F.col("q")).alias("score"))
    return X.contrastive(pairs, 0.1).select("row", F.round("loss", 6).alias("loss"))


@plan(f"{BASE} SELECT vec_id, len(v) = 64 AS ok, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e")
def vector_check(spark, d):
    return rows(spark, d).select(F.col("item").alias("vec_id"), V.checked(F.col("v"), 64).alias("ok"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@plan(f"""{BASE}, s AS (SELECT query_id, vec_id, {COS} AS score FROM e, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM s WHERE vec_id <> query_id)
SELECT query_id, avg((a.label = b.label)::INT)::DOUBLE AS agreement FROM t JOIN e a ON a.vec_id = t.vec_id JOIN e b ON b.vec_id = query_id WHERE r <= 10 GROUP BY 1""")
def label_recall(spark, d):
    r = rows(spark, d)
    near = X.knn(r, asked(spark, d), 11).filter("item != query_id").select("query_id", "item", "score")
    near = top_k(near, 10, tie="item").join(r.select("item", "label"), "item")
    own = r.select(F.col("item").alias("query_id"), F.col("label").alias("own")).filter("query_id % 20 = 0")
    return near.join(small(own), "query_id").groupBy("query_id").agg(F.avg((F.col("label") == F.col("own")).cast("int")).alias("agreement"))
