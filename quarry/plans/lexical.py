"""Lexical queries.  Questions: every benchmark item whose id is divisible by 20, with all its terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.identity import packed_ids, unpacked_ids
from quarry.functions.text import atoms, squeeze, tokens, unicode_terms
from quarry.operators import lexical as L
from quarry.sources.readers import table

TERMS = ["the", "and", "are", "that", "with", "from"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return L.query_terms(rows)


def scored(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("query_id", *keep, F.col("seg").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:-[a-z0-9]+)*')"
BASE = f"""
WITH tk AS (SELECT doc_id, lang, source, {TOK} AS w FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS term FROM benchmark WHERE item_id % 20 = 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk)"""


def ranked(select: str, score: str = "score") -> str:
    return f"""{BASE}, s AS ({select})
SELECT query_id, doc_id, rank::INTEGER AS rank, round({score}, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


BM25_SUM = """SELECT query_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / avgdl)))) AS score
FROM q JOIN tf USING (term) JOIN df USING (term) JOIN tk USING (doc_id), st GROUP BY 1, 2"""

Q, O = {}, {}


def plan(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@plan(f"{BASE} SELECT lang, count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS n_tokens, max(len(w))::BIGINT AS longest FROM tk GROUP BY 1")
def tokenize_stats(spark, d):
    n = F.size("w").cast("long")
    return docs(spark, d).select("lang", tokens(F.coalesce("text", F.lit(""))).alias("w")).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"))


@plan(f"{BASE} SELECT term, doc_id, count(*)::BIGINT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tk) WHERE term IN ('thea', 'idiot', 'mit', 'license') GROUP BY 1, 2")
def positional_postings(spark, d):
    few = docs(spark, d).filter(F.arrays_overlap(tokens("text"), F.array(*map(F.lit, ("thea", "idiot", "mit", "license")))))
    rows = L.postings(few).filter(F.col("term").isin("thea", "idiot", "mit", "license"))
    return rows.select("term", F.col("seg").alias("doc_id"), "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@plan(f"{BASE} SELECT term, df::BIGINT AS df FROM df ORDER BY df DESC, term LIMIT 50")
def doc_freq_top(spark, d):
    rows = docs(spark, d).select(F.explode(F.array_distinct(tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return rows.orderBy(F.desc("df"), "term").limit(50)


@plan(ranked("SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM q JOIN tf USING (term) GROUP BY 1, 2"))
def overlap_topk(spark, d):
    return scored(L.overlap(docs(spark, d), questions(spark, d)))


@plan(ranked("SELECT query_id, tf.doc_id, sum(tf * ln(n::DOUBLE / df)) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2"))
def tfidf_raw(spark, d):
    return scored(L.tfidf(docs(spark, d), questions(spark, d)))


@plan(ranked("SELECT query_id, tf.doc_id, sum((1 + ln(tf)) * ln(n::DOUBLE / df)) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2"))
def tfidf_sublinear(spark, d):
    return scored(L.tfidf(docs(spark, d), questions(spark, d), mode="sublinear"))


@plan(ranked("""SELECT a.query_id, a.doc_id, coalesce(a.s / nullif(b.norm * c.qn, 0), 0) AS score
FROM (SELECT query_id, tf.doc_id, sum(tf * ln(n::DOUBLE / df) * ln(n::DOUBLE / df)) AS s FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2) a
JOIN (SELECT doc_id, sqrt(sum((tf * ln(n::DOUBLE / df)) ^ 2)) AS norm FROM tf JOIN df USING (term), st GROUP BY 1) b USING (doc_id)
JOIN (SELECT query_id, sqrt(sum(ln(n::DOUBLE / df) ^ 2)) AS qn FROM q JOIN df USING (term), st GROUP BY 1) c USING (query_id)"""))
def tfidf_cosine(spark, d):
    return scored(L.tfidf(docs(spark, d), questions(spark, d), mode="cosine"))


@plan(ranked(BM25_SUM))
def bm25_topk(spark, d):
    return scored(L.bm25(docs(spark, d), questions(spark, d)))


@plan(ranked(BM25_SUM))
def wand_topk(spark, d):
    return scored(L.safe_top_k(docs(spark, d), questions(spark, d)))


@plan(f"""{BASE}, tl AS (SELECT tf.*, lang, len(w) AS l FROM tf JOIN tk USING (doc_id)),
dl AS (SELECT lang, term, count(*) AS df FROM tl GROUP BY ALL), sl AS (SELECT lang, count(*) AS n, avg(len(w)) AS avgdl FROM tk GROUP BY 1),
s AS (SELECT query_id, tl.lang, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / avgdl)))) AS score FROM q JOIN tl USING (term) JOIN dl USING (lang, term) JOIN sl USING (lang) GROUP BY ALL)
SELECT query_id, lang, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def bm25_scoped(spark, d):
    return scored(L.bm25(docs(spark, d), questions(spark, d), 3, scope=("lang",)), "lang")


@plan(f"""{BASE}, p AS (SELECT term, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / avgdl))) AS part FROM tf JOIN df USING (term) JOIN tk USING (doc_id), st WHERE doc_id = 2)
SELECT query_id, q.term, coalesce(tf, 0)::BIGINT AS tf, round(coalesce(part, 0), 6) AS part FROM q LEFT JOIN p USING (term)""")
def bm25_explain(spark, d):
    return L.bm25_explain(docs(spark, d), questions(spark, d), 2).select("query_id", "term", F.col("tf").cast("long").alias("tf"), F.round("part", 6).alias("part"))


@plan(f"""{BASE}, i AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / avgdl))) AS impact FROM tf JOIN df USING (term) JOIN tk USING (doc_id), st WHERE term IN (SELECT term FROM q))
SELECT term, count(*)::BIGINT AS n, round(max(impact), 6) AS bound, round(sum(impact), 4) AS total FROM i GROUP BY 1""")
def bm25_impacts_bound(spark, d):
    return L.impacts(docs(spark, d), questions(spark, d)).groupBy("term").agg(F.count("*").alias("n"), F.round(F.max("bound"), 6).alias("bound"), F.round(F.sum("impact"), 4).alias("total"))


@plan(f"{BASE} SELECT doc_id FROM tk WHERE list_contains(w, 'the') AND list_contains(w, 'this') AND (list_contains(w, 'thea') OR list_contains(w, 'hest')) AND NOT list_contains(w, 'onea')")
def boolean_and_or_not(spark, d):
    return L.boolean(docs(spark, d), ["the", "this"], ["thea", "hest"], ["onea"]).select(F.col("seg").alias("doc_id"))


@plan(f"{BASE}, p AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM tk) SELECT a.doc_id, count(*)::BIGINT AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY 1")
def phrase_match(spark, d):
    return L.phrase(docs(spark, d), ["of", "the"]).select(F.col("seg").alias("doc_id"), F.col("n").cast("long").alias("n"))


@plan(r"SELECT doc_id, len(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'))::BIGINT AS n FROM documents")
def unicode_words(spark, d):
    return docs(spark, d).select("doc_id", F.size(unicode_terms(F.col("text"))).cast("long").alias("n"))


@plan(ranked("SELECT query_id, doc_id, count(*) / sqrt(any_value(asked)::DOUBLE * any_value(sz)) AS score FROM q JOIN tf USING (term) JOIN (SELECT query_id, count(*) AS asked FROM q GROUP BY 1) USING (query_id) JOIN (SELECT doc_id, count(*) AS sz FROM tf GROUP BY 1) USING (doc_id) GROUP BY 1, 2"))
def binary_cosine(spark, d):
    return scored(L.binary_cosine(docs(spark, d), questions(spark, d)))


@plan(f"""{BASE}, g AS (SELECT unnest([0.8, 1.2, 1.6]) AS k1), h AS (SELECT unnest([0.0, 0.4, 0.75, 1.0]) AS b),
s AS (SELECT k1, b, query_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / avgdl)))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN tk USING (doc_id), st, g, h GROUP BY ALL)
SELECT k1::DOUBLE AS k1, b::DOUBLE AS b, query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r = 1""")
def bm25_grid(spark, d):
    """All settings in one plan: twelve sums of a query's postings in a segment."""
    hits = L.with_df(L.matched(docs(spark, d), questions(spark, d)), questions(spark, d)).crossJoin(F.broadcast(L.corpus_stats(docs(spark, d)))).join(L.small(questions(spark, d)), "term")
    grid = [(k, b) for k in (0.8, 1.2, 1.6) for b in (0.0, 0.4, 0.75, 1.0)]
    part = lambda k, b: F.sum(L.bm25_idf(F.col("n"), F.col("df")) * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avgdl"))))
    sums = hits.groupBy("query_id", "seg").agg(*(part(k, b).alias(f"s{i}") for i, (k, b) in enumerate(grid)))
    each = F.array(*(F.struct(F.lit(k).alias("k1"), F.lit(b).alias("b"), F.col(f"s{i}").alias("score")) for i, (k, b) in enumerate(grid)))
    rows = sums.select("query_id", "seg", F.explode(each).alias("g")).select("query_id", "seg", "g.*")
    return L.top_k(rows, 1, ("k1", "b", "query_id")).select("k1", "b", "query_id", F.col("seg").alias("doc_id"), F.round("score", 6).alias("score"))


@plan(r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::BIGINT AS n FROM documents")
def squeezed_lengths(spark, d):
    return docs(spark, d).select("doc_id", F.length(squeeze(F.col("text"))).cast("long").alias("n"))


@plan()
def protected_atoms(spark, d):
    return table(spark, d, "benchmark").select("item_id", atoms(F.col("text")).alias("atoms"))


@plan(f"{BASE} SELECT term, doc_id, (doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0))::BIGINT AS gap FROM tf WHERE term IN ('thea', 'hest')")
def docid_gaps(spark, d):
    from pyspark.sql import Window

    rows = docs(spark, d).select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("term")).filter(F.col("term").isin("thea", "hest"))
    return rows.select("term", "doc_id", (F.col("doc_id") - F.lag("doc_id", 1, 0).over(Window.partitionBy("term").orderBy("doc_id"))).alias("gap"))


@plan(f"{BASE} SELECT term, count(*)::BIGINT AS n, sum(doc_id + 1)::BIGINT AS checksum FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1")
def postings_codec(spark, d):
    """Ids through the gap and byte codec and back."""
    lists = L.matched(docs(spark, d), questions(spark, d)).groupBy("term").agg(F.sort_array(F.collect_list(F.col("seg") + 1)).alias("ids"))
    back = lists.select("term", F.explode(unpacked_ids(packed_ids("ids"))).alias("i"))
    return back.groupBy("term").agg(F.count("*").alias("n"), F.sum("i").alias("checksum"))
