"""Field, metadata, version, execution, training, prompt and storage queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.vectors import unit
from quarry.operators import execution as X
from quarry.operators import fields as D
from quarry.operators import generations as G
from quarry.operators import lexical as L
from quarry.operators import metadata as M
from quarry.operators import prompts as P
from quarry.operators import storage as S
from quarry.operators import training as T
from quarry.operators import vector as V
from quarry.operators.lexical import small
from quarry.plans.flows import LOG, grades, log
from quarry.plans.lexical import BM25_SUM, TOK, docs, questions
from quarry.plans.lexical import BASE as LEX
from quarry.plans.vector import BASE as VEC
from quarry.plans.vector import ASSIGN, COS, asked, books, lists, rows
from quarry.sources import generators as N
from quarry.sources.readers import table

Q, O = {}, {}


def plan(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def titled(spark, d):
    """The first 40 characters of a text's first line are its title, the whole text its body."""
    return docs(spark, d).select("doc_id", "lang", "source", F.substring(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0), 1, 40).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


TITLED = f"""d AS (SELECT doc_id, lang, source, substring(regexp_extract(coalesce(text, ''), '^[^\\n]*'), 1, 40) AS title, coalesce(text, '') AS body FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS term FROM benchmark WHERE item_id % 20 = 0),
ft AS (SELECT doc_id, term, count(*) FILTER (f = 't') AS t, count(*) FILTER (f = 'b') AS b FROM (SELECT doc_id, 't' AS f, unnest({TOK.replace("coalesce(text, '')", 'title')}) AS term FROM d UNION ALL SELECT doc_id, 'b', unnest({TOK.replace("coalesce(text, '')", 'body')}) FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM ft GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM d)"""
BEST = "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"


def scored(df):
    return df.select("query_id", F.col("seg").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@plan(f"WITH {TITLED} SELECT term, doc_id, t::INTEGER AS title_tf, b::INTEGER AS body_tf FROM ft WHERE term IN (SELECT term FROM q)")
def field_postings(spark, d):
    hits = D.field_postings(titled(spark, d)).join(small(questions(spark, d).select("term").distinct()), "term", "left_semi")
    return hits.select("term", F.col("seg").alias("doc_id"), "title_tf", "body_tf")


@plan(f"WITH {TITLED} SELECT doc_id, len({TOK.replace("coalesce(text, '')", 'title')})::INTEGER AS title_len, len({TOK.replace("coalesce(text, '')", 'body')})::INTEGER AS body_len FROM d")
def field_lengths(spark, d):
    return D.field_lengths(titled(spark, d)).withColumnRenamed("seg", "doc_id")


@plan(f"WITH {TITLED}, s AS (SELECT query_id, doc_id, sum((b + 2.0 * t) * ln(n / df)) AS score FROM q JOIN ft USING (term) JOIN df USING (term), n GROUP BY 1, 2) {BEST}")
def tfidf_title_boost(spark, d):
    return scored(D.boosted_tfidf(titled(spark, d), questions(spark, d)))


@plan(f"WITH {TITLED}, s AS (SELECT query_id, doc_id, sum((CASE WHEN b > 0 THEN 1 + ln(b) ELSE 0 END + 2.0 * CASE WHEN t > 0 THEN 1 + ln(t) ELSE 0 END) * ln(n / df)) AS score FROM q JOIN ft USING (term) JOIN df USING (term), n GROUP BY 1, 2) {BEST}")
def tfidf_title_boost_sublinear(spark, d):
    return scored(D.boosted_tfidf(titled(spark, d), questions(spark, d), mode="sublinear"))


@plan(f"WITH {TITLED} SELECT query_id, q.term, coalesce(t, 0)::INTEGER AS title_tf, coalesce(b, 0)::INTEGER AS body_tf, round(coalesce(ln(n / df), 0), 6) AS idf, round((coalesce(b, 0) + 2.0 * coalesce(t, 0)) * coalesce(ln(n / df), 0), 6) AS part FROM q LEFT JOIN df USING (term) LEFT JOIN (SELECT * FROM ft WHERE doc_id = 2) f ON f.term = q.term, n")
def tfidf_explain(spark, d):
    few = docs(spark, d).select(F.col("doc_id").alias("seg"))
    return D.explain_tfidf(titled(spark, d), questions(spark, d), 2, few).withColumns({c: F.round(c, 6) for c in ("idf", "part")})


@plan(f"""WITH tk AS (SELECT doc_id, regexp_extract_all(lower(substring(regexp_extract(coalesce(text, ''), '^[^\\n]*'), 1, 40) || chr(10) || coalesce(text, '')), '[a-z0-9]+(?:-[a-z0-9]+)*') AS w FROM documents WHERE lang = 'en'),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS term FROM benchmark WHERE item_id % 20 = 0), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk), s AS ({BM25_SUM})
SELECT query_id, tk.doc_id, round(coalesce(score, 0), 6) AS score FROM tk CROSS JOIN (SELECT DISTINCT query_id FROM q) x LEFT JOIN s USING (query_id, doc_id)""")
def bm25_merged_view(spark, d):
    """Statistics of the view alone; records without a term keep a score of zero."""
    return D.merged_bm25(titled(spark, d).filter("lang = 'en'"), questions(spark, d)).select("query_id", F.col("seg").alias("doc_id"), F.round("score", 6).alias("score"))


@plan(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_-]+')) AS term FROM documents), q AS (SELECT DISTINCT page_id AS query_id, unnest(regexp_extract_all(lower(url), '[0-9A-Za-z_-]+')) AS term FROM pages WHERE page_id % 20 = 0),
s AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM q JOIN w USING (term) GROUP BY 1, 2) SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r = 1""")
def flat_overlap(spark, d):
    urls = table(spark, d, "pages").filter("page_id % 20 = 0").select(F.col("page_id").alias("query_id"), F.col("url").alias("text"))
    return D.flat_overlap(docs(spark, d), urls).select("query_id", F.col("seg").alias("doc_id"), "score")


def described(spark, d):
    """Orders as records with typed metadata, some of them wrong in one way each."""
    k = F.col("o_orderkey")
    when = lambda n, bad, good: F.when(k % 97 == n, bad).otherwise(good)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select(
        k.cast("string").alias("record_id"), when(1, F.lit(""), F.col("o_orderstatus")).alias("tenant"), F.lit("o").alias("owner"), when(2, F.lit(None), F.col("o_custkey").cast("string")).alias("entity"), F.lit("p").alias("parent_id"),
        when(3, F.lit(0), F.lit(1)).alias("version"), when(4, F.array().cast("array<string>"), when(5, F.array(F.lit("a"), F.lit("a")), F.array(F.col("o_orderstatus")))).alias("roles"), when(6, F.lit(""), F.lit(None)).alias("language"),
        when(7, F.lit(2.0), F.lit(0.5)).alias("confidence"), F.concat(day, when(8, F.lit("T00:00:00"), F.lit("T00:00:00Z"))).alias("published_at"), F.concat(day, F.lit("T12:00:00+01:00")).alias("updated_at"),
        when(9, F.lit("0"), F.lit("1")).alias("schema_version"), F.lit("1").alias("policy_version"),
    )


@plan("""SELECT CASE o_orderkey % 97 WHEN 9 THEN 'version' WHEN 1 THEN 'identity' WHEN 2 THEN 'identity' WHEN 3 THEN 'source_version' WHEN 4 THEN 'roles' WHEN 5 THEN 'repeated_role' WHEN 6 THEN 'language' WHEN 7 THEN 'confidence' WHEN 8 THEN 'instant' END AS problem,
CASE WHEN o_orderkey % 97 BETWEEN 1 AND 9 THEN 'blocked' ELSE 'ready' END AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2""")
def metadata_ingest(spark, d):
    return M.ingested(described(spark, d), "1", "1").groupBy("problem", "status").agg(F.count("*").alias("n"))


@plan("SELECT o_orderkey::VARCHAR AS record_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 97 <> 1 AND o_custkey % 10 = 3")
def metadata_postings(spark, d):
    shelf = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), (F.col("o_custkey") % 10).alias("shelf"))
    view = described(spark, d).join(shelf, "record_id")
    return M.selected(M.field_postings(view, "tenant", "shelf"), {"tenant": "F", "shelf": "3"})


@plan("SELECT record_id, text_digest, metadata_digest FROM (SELECT doc_id AS record_id, sha256(text) AS text_digest, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS metadata_digest FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL)")
def metadata_manifest(spark, d):
    rows_ = docs(spark, d).filter("lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL").withColumnRenamed("doc_id", "record_id")
    return M.manifest_rows(rows_, rows_, "lang", "source")


@plan("SELECT lang AS query_id, doc_id AS record_id, CASE WHEN n_chars >= 1000 THEN 'found' ELSE 'reviewed' END AS side FROM documents WHERE (n_chars >= 1000) <> (doc_id % 2 = 0)")
def predicate_disagreements(spark, d):
    r = docs(spark, d).select(F.col("lang").alias("query_id"), F.col("doc_id").alias("record_id"), "n_chars")
    return M.disagreements(r.filter("n_chars >= 1000"), r.filter("record_id % 2 = 0"))


@plan("SELECT doc_id AS label_id FROM documents WHERE NOT (doc_id % 5 <> 0 OR length(text) <= 3)")
def evidence_mismatches(spark, d):
    """Spans of four characters; every fifth says that it begins one place later than it does."""
    r = docs(spark, d).select(F.col("doc_id").alias("label_id"), "doc_id", F.lit(0).alias("a"), F.lit(3).alias("z"), F.when((F.col("doc_id") % 5 == 0) & (F.length("text") > 3), F.concat(F.lit("\u0000"), F.substring("text", 2, 2))).otherwise(F.substring("text", 1, 3)).alias("text"))
    return M.bad_evidence(r, docs(spark, d))


@plan(f"""{VEC}, s AS (SELECT query_id, vec_id, label, {COS} AS score FROM e, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM s),
x AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM s WHERE label < 5) WHERE r <= 5)
SELECT query_id, count(*) FILTER (r <= 5 AND label >= 5)::BIGINT AS violations, round(count(*) FILTER (r <= 5 AND x.vec_id IS NOT NULL)::DOUBLE / count(x.vec_id), 6) AS exact_recall, count(*) FILTER (label < 5)::BIGINT AS eligible FROM t LEFT JOIN x USING (query_id, vec_id) GROUP BY 1""")
def plan_quality(spark, d):
    """Five nearest without the filter, held against the plan that filters first."""
    r, q = rows(spark, d), asked(spark, d)
    may = r.filter("label < 5").select("item")
    exact = V.prefiltered(r, q, F.col("label") < 5, 5)
    return M.plan_quality(V.knn(r, q, 5), exact, may, exact, 5).select("query_id", "violations", F.round("exact_recall", 6).alias("exact_recall"), "eligible")


HIST = f"{LOG}, h AS (SELECT source, revision, op, effective, payload, sha256(coalesce(payload, '')) AS digest FROM l)"


def history(spark, d):
    w = log(spark, d).filter(~F.col("event_id").rlike("[bc]$")).dropDuplicates(["source", "revision"])
    return w.select("source", "revision", "op", "effective", F.coalesce("payload", F.lit("")).alias("payload"), "event_id").withColumn("digest", F.sha2("payload", 256))


@plan(f"{HIST} SELECT source || '@' || revision AS key, digest FROM h")
def version_capsules(spark, d):
    h = history(spark, d)
    return G.capsules(h.filter("revision = 1"), h.filter("revision > 1")).select("key", "digest")


@plan(f"{HIST} SELECT source, revision, effective + CASE WHEN (source + revision) % 5 = 0 THEN 3600000 ELSE 0 END AS received, (source + revision) % 5 = 0 AS late FROM h")
def delivery_schedule(spark, d):
    return G.schedule(history(spark, d), 5, 3600000).select("source", "revision", "received", "late")


def generation(spark, d):
    h = history(spark, d)
    v = h.select(F.concat_ws("@", "source", "revision").alias("key"), F.col("source") % 3 + 1.0, F.col("revision") % 5 + 1.0).toDF("key", "x", "y").select("key", unit(F.array("x", "y")).alias("v"))
    return G.materialized(h, G.capsules(h.filter("revision = 1"), h.filter("revision > 1")), v, 2)


@plan(f"{HIST} SELECT source, count(*)::BIGINT AS versions, max(revision)::BIGINT AS newest FROM h WHERE op <> 'delete' GROUP BY 1")
def generation_rows(spark, d):
    return generation(spark, d).groupBy("source").agg(F.count("*").alias("versions"), F.max("revision").alias("newest"))


@plan(f"{HIST} SELECT source, count(*)::BIGINT AS versions FROM h GROUP BY 1")
def state_restored(spark, d):
    return G.restored(G.state_payload(history(spark, d))).groupBy("source").agg(F.count("*").alias("versions"))


@plan(f"{HIST}, old AS (SELECT source, revision FROM h WHERE revision <= 3 QUALIFY row_number() OVER (PARTITION BY source ORDER BY revision DESC) = 1), t AS (SELECT source, arg_max(op, revision) AS op, max(revision) AS revision FROM h GROUP BY 1) SELECT source, t.revision::BIGINT AS revision FROM t LEFT JOIN old USING (source) WHERE NOT (t.op = 'delete' AND t.revision > coalesce(old.revision, 0))")
def generation_published(spark, d):
    """A table of the third revisions, brought up to date by all events at once."""
    h = history(spark, d)
    w = Window.partitionBy("source").orderBy(F.desc("revision"))
    old = h.filter("revision <= 3").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return G.published(old, h).select("source", "revision")


@plan(f"{HIST} SELECT source, revision::BIGINT AS revision FROM (SELECT source, arg_max(op, revision) AS op, max(revision) AS revision FROM h WHERE effective <= 1706140800000 GROUP BY 1) WHERE op <> 'delete'")
def relevant_versions(spark, d):
    h = history(spark, d)
    judged = h.select("source").distinct().select(F.col("source").alias("query_id"), "source", F.lit(1706140800000).alias("at"))
    return G.relevant_as_of(judged, h).select("source", "revision")


@plan(f"{HIST}, g AS (SELECT source, max(revision) AS revision FROM h GROUP BY 1) SELECT source AS query_id, source || '@' || revision AS key FROM g WHERE source % 2 = 0")
def ranked_versions(spark, d):
    h = history(spark, d)
    heads = h.groupBy("source").agg(F.max("revision").alias("revision")).join(h.select("source", "revision", "digest"), ["source", "revision"])
    ranked = heads.filter("source % 2 = 0").select(F.col("source").alias("query_id"), "source", F.lit(1).alias("rank"))
    return G.versions_of(ranked, heads, G.capsules(h.filter("revision = 1"), h.filter("revision > 1"))).select("query_id", "key")


@plan("SELECT c_custkey AS item, 1 AS rank, sha256(concat_ws(chr(31), c_nationkey, 'a', 'g', 'c', c_custkey, chr(30))) AS key FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def cache_reads(spark, d):
    """Results kept for every customer; half are asked for, and every third may no longer be seen."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.lit(1).alias("rank"), "c_nationkey")
    key = G.cache_key(F.col("c_nationkey"), F.lit("a"), F.lit("g"), F.lit("c"), F.col("item"), F.lit(None))
    empty = spark.createDataFrame([], "key string, item long, rank int")
    kept = G.kept(empty, F.col("key"), c.withColumn("key", key))
    return G.cached(kept, c.filter("item % 2 = 0").select(key.alias("key")), c.filter("item % 3 != 0").select("item"))


@plan(f"""{LEX}, s AS ({BM25_SUM}), v AS (SELECT doc_id FROM documents WHERE lang = 'en'), p AS (SELECT query_id, CASE WHEN query_id // 20 % 4 = 0 THEN NULL WHEN query_id // 20 % 4 = 1 THEN 'lexical' WHEN query_id // 20 % 4 = 2 THEN 'dense' ELSE 'web' END AS route FROM (SELECT DISTINCT query_id FROM q)),
r AS (SELECT s.query_id, doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s JOIN v USING (doc_id) JOIN p USING (query_id) WHERE route IN ('lexical', 'dense'))
SELECT query_id, CASE WHEN route IS NULL THEN 'clarify' WHEN route = 'web' THEN 'failed' WHEN doc_id IS NULL THEN 'empty' ELSE 'ready' END AS outcome, CASE WHEN route IN ('lexical', 'dense') THEN 'lexical' END AS route, CASE route WHEN 'lexical' THEN 1 WHEN 'dense' THEN 2 WHEN 'web' THEN 1 ELSE 0 END::INTEGER AS attempts, doc_id AS item, rank::INTEGER AS rank FROM p LEFT JOIN (SELECT * FROM r WHERE rank <= 2) USING (query_id)""")
def routed_execution(spark, d):
    """Queries by lexical search, by a dense route that fails over to it, by one that fails, and without one."""
    q = questions(spark, d).select("query_id").distinct()
    kind = F.floor(F.col("query_id") / 20) % 4
    plans = q.select("query_id", F.when(kind == 0, "clarify").otherwise("ready").alias("outcome"), F.when(kind == 1, "lexical").when(kind == 2, "dense").when(kind == 3, "web").alias("route"), F.when(kind == 2, "lexical").alias("other"))
    view = docs(spark, d).filter("lang = 'en'").select(F.col("doc_id").alias("item")).crossJoin(small(q))
    lexical = lambda mine: L.bm25(docs(spark, d), questions(spark, d).join(mine, "query_id", "left_semi"), 1 << 30).select("query_id", F.col("seg").alias("item"), "score")
    return X.routed(plans, view, {"lexical": lexical}, 2, ("dense", "web")).select("query_id", "outcome", "route", "attempts", "item", "rank")


@plan(f"""WITH b AS (SELECT item_id AS query_id, 0 AS branch, text FROM benchmark WHERE item_id % 20 = 0 UNION ALL SELECT item_id, 1, substring(text, 1, length(text) // 2) FROM benchmark WHERE item_id % 20 = 0),
tk AS (SELECT doc_id, {TOK} AS w FROM documents), q AS (SELECT DISTINCT query_id, branch, unnest({TOK}) AS term FROM b), tf AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM tk),
s AS (SELECT query_id, branch, doc_id, count(*)::DOUBLE AS score FROM q JOIN tf USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, doc_id) AS rank FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, branch) AS k FROM r WHERE rank <= 5)
SELECT query_id, place::INTEGER AS place, branch::INTEGER AS branch, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, branch, doc_id) AS place FROM o WHERE k = 1) WHERE place <= 6""")
def fan_out(spark, d):
    """Each question and its first half as a second branch."""
    q = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    half = q.select("query_id", F.lit(1).alias("n"), F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"))

    def search(branches):
        terms = L.query_terms(branches.withColumnRenamed("branch_id", "query_id"))
        return L.overlap(docs(spark, d), terms, 5).select(F.col("query_id").alias("branch_id"), F.col("seg").alias("item"), "rank")

    return X.fan_out(q, half, search, 6).select("query_id", "place", "branch", F.col("item").alias("doc_id"))


@plan("SELECT item_id AS query_id, sha256(text) AS text_digest FROM benchmark")
def public_plans(spark, d):
    from quarry.operators.queries import interpret

    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return X.public_plan(interpret(b).join(b, "query_id")).select("query_id", "text_digest")


@plan(f"""{VEC}, t AS (SELECT vec_id, unnest(range(64)) AS col, unnest(v) AS a FROM e), x AS (SELECT unnest(range(64)) AS col, unnest(v) AS x FROM e WHERE vec_id = 0) SELECT vec_id AS row, round(sum(a * x), 6) AS y FROM t JOIN x USING (col) GROUP BY 1""")
def matrix_vector(spark, d):
    m = rows(spark, d).select(F.col("item").alias("row"), F.posexplode("v").alias("col", "a"))
    x = rows(spark, d).filter("item = 0").select(F.posexplode("v").alias("col", "x"))
    return T.matrix_vector(m, F.broadcast(x)).select("row", F.round("y", 6).alias("y"))  # one vector


@plan(f"""{VEC}, m AS (SELECT vec_id, list_transform(v, lambda x, i: x + CASE WHEN i <= 2 THEN 0.5 * (v[1] + v[2]) ELSE 0 END) AS v FROM e) SELECT vec_id, round(list_sum(v[1:2]) / sqrt(list_dot_product(v, v)), 6) AS head FROM m""")
def adapted_vectors(spark, d):
    """A rank-one adapter that adds half the sum of the first two components to each of them."""
    a = [[1.0, 1.0] + [0.0] * 62]
    b = [[0.5], [0.5]] + [[0.0]] * 62
    v = T.adapted(F.col("v"), a, b)
    return rows(spark, d).select(F.col("item").alias("vec_id"), v.alias("v")).select("vec_id", F.round(F.get("v", 0) + F.get("v", 1), 6).alias("head"))


@plan("SELECT family, variant, count(*)::BIGINT AS n FROM (SELECT unnest(['position','position','position','conflict','conflict','instruction','instruction','untrusted','untrusted','missing']) AS family, unnest(['first','middle','last','newer','older','base','strict','inline','fenced','absent']) AS variant) CROSS JOIN benchmark GROUP BY 1, 2")
def prompt_cases(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("the answer").alias("answer"), F.array(F.lit("one"), F.lit("two")).alias("others"))
    return P.case_manifest(P.cases(q)).groupBy("family", "variant").agg(F.count("*").alias("n"))


@plan("SELECT doc_id AS claim_id, CASE WHEN doc_id % 4 = 0 THEN 'no_document' WHEN doc_id % 4 = 1 THEN 'ok' WHEN doc_id % 4 = 2 AND substring(text, 2, 8) <> substring(text, 1, 8) THEN 'wrong_place' WHEN doc_id % 4 = 2 THEN 'ok' ELSE 'absent' END AS status FROM documents WHERE length(text) > 8")
def quote_audit(spark, d):
    t = docs(spark, d).filter("length(text) > 8")
    k = F.col("doc_id") % 4
    claims = t.select(F.col("doc_id").alias("claim_id"), F.when(k == 0, F.lit(-1)).otherwise(F.col("doc_id")).alias("doc_id"), F.when(k == 2, 1).otherwise(0).alias("a"), F.when(k == 2, 9).otherwise(8).alias("z"), F.when(k == 3, F.lit("\u0000")).otherwise(F.substring("text", 1, 8)).alias("quote"))
    return P.audit_quotes(claims, t)


@plan("SELECT source, count(DISTINCT p)::BIGINT AS n FROM (SELECT lang AS source, unnest(range(length(text))) AS p, unnest(string_split(text, '')) AS c FROM documents) WHERE NOT regexp_matches(c, '\\s') GROUP BY 1")
def source_positions(spark, d):
    t = docs(spark, d).filter("length(text) > 0").select(F.concat(F.lit("also "), "lang").alias("source"), F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    alias = docs(spark, d).select("lang").distinct().select(F.concat(F.lit("also "), "lang").alias("alias"), F.col("lang").alias("source"))
    return P.positions(t, alias)


@plan()
def page_cache(spark, d):
    """Each user's events in order, eight a beam, read from pages of 16 products behind a cache of four."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", ((F.row_number().over(w) - 1) / 8).cast("long").alias("beam"), F.row_number().over(w).alias("n"), F.floor(F.col("event_id") % 97 / 16).alias("page"))
    beams = e.groupBy(F.col("user_id").alias("trace"), "beam").agg(F.array_sort(F.collect_list(F.struct("n", "page"))).alias("p")).select("trace", "beam", F.transform("p", lambda x: x["page"]).alias("pages"))
    return S.replay(beams, 4)


@plan(f"{ASSIGN} SELECT list_id::INTEGER AS list_id, count(*)::BIGINT AS n FROM a WHERE vec_id % 7 <> 0 GROUP BY 1")
def ivf_lifecycle(spark, d):
    """Even items first, odd ones added, every seventh deleted."""
    r = rows(spark, d)
    index = V.assign(r.filter("item % 2 = 0").select("item", "v"), lists(spark, d))
    index = V.ivf_add(index, r.filter("item % 2 = 1"), lists(spark, d))
    return V.ivf_delete(index, r.filter("item % 7 = 0")).groupBy("list_id").agg(F.count("*").alias("n"))


@plan()
def pq_errors(spark, d):
    coded = V.pq_encode(V.residuals(rows(spark, d), lists(spark, d)), books(spark, d))
    return V.reconstruction_error(coded, lists(spark, d), books(spark, d)).select(F.col("item").alias("vec_id"), F.round("error", 6).alias("error"))


@plan("SELECT count(*)::BIGINT AS n, count(DISTINCT k)::BIGINT AS ids, max(k)::BIGINT AS top FROM (SELECT doc_id + c * (SELECT max(doc_id) + 1 FROM documents) AS k FROM documents, range(3) r(c))")
def cloned_corpus(spark, d):
    return N.cloned(docs(spark, d), 3).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.max("doc_id").alias("top"))


@plan("SELECT 256::BIGINT AS asked, 128::BIGINT AS hits")
def keyed_lookups(spark, d):
    found = N.hash_find(N.records(spark, 1000), N.lookups(spark, 1000))
    return found.agg(F.count("*").alias("asked"), F.count("value").alias("hits"))


@plan("SELECT 1.0::DOUBLE AS recall")
def planted_neighbours(spark, d):
    r = N.gaussian(spark, 500, 32)
    p = N.planted(r, 20, 0.02)
    return V.recall(V.knn(r, p.select("query_id", "v"), 1), p.select("query_id", "item"), 1).agg(F.avg("recall").alias("recall"))


@plan(f"{LEX}, g AS (SELECT doc_id, max(CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END) AS grade FROM labels GROUP BY 1), s AS ({BM25_SUM}), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10), p AS (SELECT query_id, min(doc_id) AS doc_id FROM r JOIN g USING (doc_id) WHERE grade > 0 GROUP BY 1)\nSELECT round(avg((rank IS NOT NULL)::INT), 6) AS hit, round(avg(coalesce(1.0 / rank, 0)), 6) AS rr, count(*)::BIGINT AS n FROM p LEFT JOIN r USING (query_id, doc_id)")
def group_scores(spark, d):
    r = L.bm25(docs(spark, d), questions(spark, d)).select("query_id", F.col("seg").alias("item"), "rank")
    good = r.join(grades(spark, d).withColumnRenamed("doc_id", "item"), "item").filter("grade > 0").groupBy("query_id").agg(F.min("item").alias("item"))
    return T.group_scores(r, good, 10).select(F.round("hit", 6).alias("hit"), F.round("rr", 6).alias("rr"), "n")
