"""Lexical retrieval: postings, statistics, scores, boolean and phrase queries.

A posting table has a row per (term, seg) with positions; statistics are local to a
scope.  Query terms come as rows (query_id, term), a set per query.  Scores join the
postings of the query terms only, so what is exchanged follows the query terms, not the
corpus.  Every top-k carries the full tie key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN, cut, tokens

K1, B = 1.2, 0.75
#: Query terms up to this many are broadcast; the bound is checked.
BROADCAST_TERMS = 100_000


def few(df: DataFrame, limit: int = BROADCAST_TERMS) -> bool:
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """Marked for broadcast only if its rows were counted to be few."""
    return F.broadcast(df) if few(df, limit) else df


def tokenized(docs: DataFrame, seg: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(seg).alias("seg"), *keep, tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def postings(docs: DataFrame, **names) -> DataFrame:
    """(term, seg, tf, positions) of a whole corpus: one exchange by (term, seg)."""
    rows = tokenized(docs, **names).select("seg", F.posexplode("tokens").alias("pos", "term"))
    return rows.groupBy("term", "seg").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def unique(docs: DataFrame, seg: str) -> bool:
    return docs.groupBy(seg).count().filter("count > 1").isEmpty()


def counted(docs: DataFrame, known: set[str] | None, keep: tuple[str, ...] = (), seg: str = "doc_id", texts: dict[str, str] | None = None) -> DataFrame:
    """(seg, *keep, len, term, a count for each of texts): a row for each term of a text, counted beside it; of known terms only.

    texts: the name of the count -> the column; len is the last one's number of tokens.
    """
    texts = texts or {"tf": "text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).findall
        for batch in batches:
            for b in cut(batch, list(texts)[-1]):
                at, size, term, counts = [], [], [], [[] for _ in texts]
                for i, row in enumerate(zip(*(b[c].to_pylist() for c in texts))):
                    words = [find(t.lower()) if t else [] for t in row]
                    each = [Counter(w if known is None else [t for t in w if t in known]) for w in words]
                    mine = each[0] if len(each) == 1 else dict.fromkeys(t for c in each for t in c)
                    at.extend([i] * len(mine))
                    size.extend([len(words[-1])] * len(mine))
                    term.extend(mine)
                    for out, c in zip(counts, each):
                        out.extend(c[t] for t in mine)
                rows = pa.array(at, pa.int64())
                kept = [b[c].take(rows) for c in ("seg", *keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(size, pa.int32()), pa.array(term, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["seg", *keep, "len", "term", *texts])

    rows = docs.select(F.col(seg).alias("seg"), *keep, *(F.col(c).alias(n) for n, c in texts.items()))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("seg", *keep))
    return rows.mapInArrow(run, f"{kinds}, len int, term string, " + ", ".join(f"{c} long" for c in texts))


def known_terms(terms: DataFrame, limit: int = BROADCAST_TERMS) -> set[str] | None:
    """The distinct terms, if they are few."""
    got = terms.select("term").distinct().limit(limit + 1).collect()
    return {r["term"] for r in got} if len(got) <= limit else None


def matched(docs: DataFrame, terms: DataFrame, keep: tuple[str, ...] = (), seg: str = "doc_id", text: str = "text") -> DataFrame:
    """(seg, len, term, tf) of the query terms only: other terms go before any exchange.

    Few terms are counted beside their text; rows of one segment are added up by an exchange, if there are any.
    """
    known = known_terms(terms)
    if known is not None:
        rows = counted(docs, known, keep, seg, {"tf": text})
        return rows if unique(docs, seg) else rows.groupBy("seg", *keep, "len", "term").agg(F.sum("tf").alias("tf"))
    rows = tokenized(docs, seg, text, keep).select("seg", *keep, F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    rows = rows.join(small(terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("seg", *keep, "len", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(*keep, len): the number of tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).findall
        for batch in batches:
            for b in cut(batch, "text"):
                size = [len(find(t.lower())) if t else 0 for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(size, pa.int32())], names=[*keep, "len"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text).alias("text")).mapInArrow(run, f"{kinds}len int")


def corpus_stats(docs: DataFrame, scope: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """N and average length by scope."""
    return lengths(docs, scope, text).groupBy(*scope).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def with_df(hits: DataFrame, terms: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Hits of the terms with df; without a scope it has a row a term at most, so counting the terms spares a pass over the corpus."""
    df = hits.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    if scope:
        df = small(df)
    elif few(terms.select("term").distinct()):
        df = F.broadcast(df)
    return hits.join(df, [*scope, "term"])


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, avgdl: Column, k1=K1, b=B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def sublinear(tf: Column) -> Column:
    return F.when(tf > 0, 1 + F.ln(tf)).otherwise(0.0)


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "seg") -> DataFrame:
    """The k best of each group, ranked from 1: score first, then the tie key."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, seg, score, rank), all statistics local to the scope."""
    hits = with_df(matched(docs, queries, keep=scope), queries, scope)
    stats = corpus_stats(docs, scope)
    hits = hits.join(F.broadcast(stats), list(scope)) if scope else hits.crossJoin(F.broadcast(stats))  # one row a scope
    hits = hits.withColumn("part", bm25_idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl"), k1, b))
    scored = hits.join(small(queries), "term").groupBy("query_id", *scope, "seg").agg(F.sum("part").alias("score"))
    return top_k(scored, k, ("query_id", *scope))


def overlap(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Distinct query terms that a segment has; zeros never appear."""
    hits = matched(docs, queries).join(small(queries), "term")
    return top_k(hits.groupBy("query_id", "seg").agg(F.count("*").cast("double").alias("score")), k)


def tfidf(docs: DataFrame, queries: DataFrame, k: int = 10, mode: str = "raw") -> DataFrame:
    """raw, sublinear or cosine (over the norm of all terms); zero-idf matches stay."""
    hits = with_df(matched(docs, queries), queries)
    n = docs.agg(F.count("*").alias("n"))
    weight = sublinear(F.col("tf")) if mode == "sublinear" else F.col("tf").cast("double")
    idf = F.ln(F.col("n") / F.col("df"))
    hits = hits.crossJoin(F.broadcast(n)).withColumn("part", weight * idf)
    scored = hits.join(small(queries), "term").groupBy("query_id", "seg").agg(F.sum("part").alias("score"), F.sum(F.col("part") * idf).alias("dotq"))
    if mode == "cosine":
        norms = tfidf_norms(docs)
        wanted = queries.join(hits.groupBy("term").agg(F.first(idf).alias("i")), "term").groupBy("query_id").agg(F.sqrt(F.sum(F.col("i") * F.col("i"))).alias("qnorm"))
        scored = scored.join(norms, "seg").join(small(wanted), "query_id").withColumn("score", F.coalesce(F.try_divide("dotq", F.col("norm") * F.col("qnorm")), F.lit(0.0)))
    return top_k(scored.select("query_id", "seg", "score"), k)


#: Terms of a whole corpus that are sent to every task; the number is counted.
VOCABULARY = 300_000


def tfidf_norms(docs: DataFrame) -> DataFrame:
    """(seg, norm) over all terms."""
    tf = counted(docs, None).select("seg", "term", "tf")
    if not unique(docs, "doc_id"):
        tf = tf.groupBy("seg", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).persist()
    n = docs.agg(F.count("*").alias("n"))
    w = F.col("tf") * F.ln(F.col("n") / F.col("df"))
    return tf.join(small(df, VOCABULARY), "term").crossJoin(F.broadcast(n)).groupBy("seg").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def bm25_explain(docs: DataFrame, queries: DataFrame, seg: int) -> DataFrame:
    """A row per query term for one segment; terms it lacks contribute 0."""
    hits = with_df(matched(docs, queries), queries).filter(F.col("seg") == seg)
    parts = hits.crossJoin(F.broadcast(corpus_stats(docs))).select("term", "tf", "df", (bm25_idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl"))).alias("part"))
    return queries.join(parts, "term", "left").select("query_id", "term", F.coalesce("tf", F.lit(0)).alias("tf"), F.coalesce("part", F.lit(0.0)).alias("part"))


def impacts(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(term, seg, impact, bound): what a term adds, and its upper bound over segments."""
    hits = with_df(matched(docs, queries), queries).crossJoin(F.broadcast(corpus_stats(docs)))
    hits = hits.select("term", "seg", (bm25_idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl"))).alias("impact"))
    bounds = hits.groupBy("term").agg(F.max("impact").alias("bound"))  # no more rows than terms
    return hits.join(F.broadcast(bounds) if few(queries.select("term").distinct()) else bounds, "term")


def safe_top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same rows as ``bm25``, scoring fewer segments; equal scores are never pruned.

    Each query's terms are ordered by their bounds.  The k-th best sum over the strongest
    term's postings is a threshold; the weakest terms, whose bounds together stay under it,
    cannot lift a segment over it alone, so only segments with one of the other terms are scored.
    """
    return top_k(pruned(docs, queries, k).groupBy("query_id", "seg").agg(F.sum("impact").alias("score")), k)


def pruned(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, term, seg, impact) of the segments that ``safe_top_k`` scores."""
    table = impacts(docs, queries).persist()
    asked = table.select("term", "bound").distinct().join(small(queries), "term")
    down = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
    up = Window.partitionBy("query_id").orderBy("bound", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("place", F.row_number().over(down)).withColumn("rest", F.sum("bound").over(up))
    seeds = top_k(table.join(small(asked.filter("place = 1").select("query_id", "term")), "term").select("query_id", "seg", F.col("impact").alias("score")), k)
    enough = seeds.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    known = seeds.join(small(enough), "query_id").select("query_id", "seg")
    full = table.join(small(asked.select("query_id", "term")), "term").join(small(known), ["query_id", "seg"]).groupBy("query_id", "seg").agg(F.sum("impact").alias("s"))
    threshold = full.groupBy("query_id").agg(F.min("s").alias("theta"))
    needed = asked.join(small(threshold), "query_id", "left").filter(F.col("theta").isNull() | (F.col("rest") >= F.col("theta") - 1e-9)).select("query_id", "term")
    alive = table.join(small(needed), "term").select("query_id", "seg").distinct()
    return table.join(small(asked.select("query_id", "term")), "term").join(alive, ["query_id", "seg"], "left_semi").select("query_id", "term", "seg", "impact")


def boolean(docs: DataFrame, all_terms=(), any_terms=(), not_terms=()) -> DataFrame:
    """Segments with all, any and none of the terms; a positive term is required."""
    if not (all_terms or any_terms):
        raise ValueError("a positive term is required")
    has = lambda ts: F.array(*map(F.lit, ts))
    rows = tokenized(docs)
    for t in all_terms:
        rows = rows.filter(F.array_contains("tokens", t))
    if any_terms:
        rows = rows.filter(F.arrays_overlap("tokens", has(any_terms)))
    if not_terms:
        rows = rows.filter(~F.arrays_overlap("tokens", has(not_terms)))
    return rows.select("seg")


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """(seg, n): places where the words stand consecutively."""
    joined = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    # looking ahead, so that a phrase may begin within the last one
    return tokenized(docs).select("seg", F.regexp_count(joined, F.lit(f"(?= {' '.join(map(re.escape, words))} )")).alias("n")).filter(F.col("n") > 0)


def binary_cosine(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Cosine of the sets of terms."""
    rows = tokenized(docs).select("seg", F.size(F.array_distinct("tokens")).alias("size"))
    asked = queries.groupBy("query_id").agg(F.count("*").alias("asked"))
    hits = matched(docs, queries).join(small(queries), "term").groupBy("query_id", "seg").agg(F.count("*").alias("both"))
    scored = hits.join(rows, "seg").join(small(asked), "query_id")
    return top_k(scored.select("query_id", "seg", (F.col("both") / F.sqrt(F.col("asked").cast("double") * F.col("size"))).alias("score")), k)


def query_terms(queries: DataFrame, n_terms: int | None = None) -> DataFrame:
    """(query_id, term): the distinct terms of (query_id, text), of its first terms if bounded."""
    words = tokens(F.col("text"))
    words = F.slice(words, 1, n_terms) if n_terms else words
    return queries.select("query_id", F.explode(F.array_distinct(words)).alias("term"))
