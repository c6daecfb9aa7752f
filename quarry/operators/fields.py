"""Lexical retrieval over two fields: title and body, with a boost and per-view statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.lexical import B, K1, bm25_idf, counted, few, known_terms, saturation, small, sublinear, top_k, unique
from quarry.operators.vector import sparse_search


def field_postings(docs: DataFrame, seg: str = "doc_id", title: str = "title", body: str = "body") -> DataFrame:
    """(term, seg, title_tf, body_tf, title_positions, body_positions): one exchange by (term, seg)."""
    words = F.array(*(F.struct(F.lit(n).alias("field"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("w")) for n, c in (("title", title), ("body", body))))
    rows = docs.select(F.col(seg).alias("seg"), F.explode(words).alias("f")).select("seg", "f.field", F.posexplode("f.w").alias("pos", "term"))
    of = lambda n: F.when(F.col("field") == n, F.col("pos"))
    out = rows.groupBy("term", "seg").agg(F.sort_array(F.collect_list(of("title"))).alias("title_positions"), F.sort_array(F.collect_list(of("body"))).alias("body_positions"))
    return out.select("term", "seg", F.size("title_positions").alias("title_tf"), F.size("body_positions").alias("body_tf"), "title_positions", "body_positions")


def field_lengths(docs: DataFrame, seg: str = "doc_id", title: str = "title", body: str = "body") -> DataFrame:
    size = lambda c: F.size(tokens(F.coalesce(F.col(c), F.lit(""))))
    return docs.select(F.col(seg).alias("seg"), size(title).alias("title_len"), size(body).alias("body_len"))


def field_counts(docs: DataFrame, queries: DataFrame, seg: str = "doc_id", title: str = "title", body: str = "body") -> DataFrame:
    """(seg, term, title_tf, body_tf) of the query terms; few terms are counted beside their texts."""
    known = known_terms(queries)
    if known is None or not unique(docs, seg):
        return field_postings(docs, seg, title, body).join(small(queries.select("term").distinct()), "term", "left_semi").select("seg", "term", "title_tf", "body_tf")
    return counted(docs, known, (), seg, {"title_tf": title, "body_tf": body}).drop("len")


def boosted_tfidf(docs: DataFrame, queries: DataFrame, k: int = 10, boost: float = 2.0, mode: str = "raw", **names) -> DataFrame:
    """Sums of (body tf + boost * title tf) ln(N / df); sublinear damps each field's count first."""
    hits = field_counts(docs, queries, **names)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    damp = sublinear if mode == "sublinear" else (lambda c: c)
    part = (damp(F.col("body_tf")) + boost * damp(F.col("title_tf"))) * F.ln(F.col("n") / F.col("df"))
    n = docs.agg(F.count("*").alias("n"))
    rows = hits.join(F.broadcast(df) if few(queries.select("term").distinct()) else df, "term").crossJoin(F.broadcast(n)).withColumn("part", part)
    return top_k(rows.join(small(queries), "term").groupBy("query_id", "seg").agg(F.sum("part").alias("score")), k)


def explain_tfidf(docs: DataFrame, queries: DataFrame, seg: int, scope: DataFrame | None = None, boost: float = 2.0, **names) -> DataFrame:
    """(query_id, term, title_tf, body_tf, idf, part) of one segment; one outside the scope (seg) is refused."""
    if scope is not None and scope.filter(F.col("seg") == seg).isEmpty():
        raise PermissionError("the segment is out of scope")
    hits = field_postings(docs, **names).join(small(queries.select("term").distinct()), "term", "left_semi")
    idf = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", F.ln(F.col("n") / F.col("df")).alias("idf"))
    own = hits.filter(F.col("seg") == seg).select("term", "title_tf", "body_tf")
    rows = queries.join(idf, "term", "left").join(own, "term", "left")
    tf = [F.coalesce(c, F.lit(0)) for c in ("title_tf", "body_tf")]
    return rows.select("query_id", "term", tf[0].alias("title_tf"), tf[1].alias("body_tf"), F.coalesce("idf", F.lit(0.0)).alias("idf"), ((tf[1] + boost * tf[0]) * F.coalesce("idf", F.lit(0.0))).alias("part"))


def merged_bm25(view: DataFrame, queries: DataFrame, seg: str = "doc_id", title: str = "title", body: str = "body") -> DataFrame:
    """(query_id, seg, score) over title and body as one text; all statistics are the view's, zeros stay."""
    words = tokens(F.concat_ws("\n", title, body))
    rows = view.select(F.col(seg).alias("seg"), words.alias("w"))
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    hits = rows.select("seg", F.size("w").alias("len"), F.explode("w").alias("term")).join(small(queries.select("term").distinct()), "term", "left_semi").groupBy("seg", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    part = bm25_idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl"), K1, B)
    scored = hits.join(small(df), "term").crossJoin(F.broadcast(stats)).withColumn("part", part).join(small(queries), "term").groupBy("query_id", "seg").agg(F.sum("part").alias("score"))
    every = view.select(F.col(seg).alias("seg")).crossJoin(small(queries.select("query_id").distinct()))  # a stated set
    return every.join(scored, ["query_id", "seg"], "left").select("query_id", "seg", F.coalesce("score", F.lit(0.0)).alias("score"))


def flat_overlap(docs: DataFrame, queries: DataFrame, k: int = 1, seg: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct words (letters, digits, underscores, hyphens) that a query (query_id, text) and a record share."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\w-]+"), F.lit(0)))
    asked = queries.select("query_id", F.explode(words("text")).alias("term")).distinct()
    hits = docs.select(F.col(seg).alias("item"), F.explode(words(text)).alias("term"), F.lit(1.0).alias("weight"))
    hits = hits.join(small(asked.select("term").distinct()), "term", "left_semi").persist()  # a few words of each text
    known = asked.join(small(hits.select("term").distinct()), "term", "left_semi")
    # queries of the same known words have the same records: one of them is searched for
    sets = known.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    kinds = sets.groupBy("terms").agg(F.min("query_id").alias("first"))
    one = kinds.select(F.col("first").alias("query_id"), F.explode("terms").alias("term"), F.lit(1.0).alias("qw"))
    best = sparse_search(hits, one, k).select(F.col("query_id").alias("first"), F.col("item").alias("seg"), "score", "rank")
    return sets.join(kinds, "terms").select("query_id", "first").join(best, "first").select("query_id", "seg", "score", "rank")
