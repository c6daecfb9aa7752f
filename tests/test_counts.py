"""Terms counted beside their texts, against rows of tokens that are exchanged."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import fields as D
from quarry.operators import lexical as L

TEXTS = ["the cat-a theKey", "İstanbul THE the", None, "", "a-b -c- d--e the", "straße ΣΑΣ the1 the", "x" * 3_000_000 + " the cat-a"]


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("twice", [False, True])
def test_counts_beside_the_text(spark, monkeypatch, twice):
    data = [(i, "en" if i % 2 else None, t) for i, t in enumerate(TEXTS)] * (2 if twice else 1)
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string").repartition(3)
    q = spark.createDataFrame([(0, t) for t in ("the", "cat-a", "i", "key", "thekey", "a-b", "stra")] + [(1, "the")], "query_id long, term string")
    names = ("seg", "lang", "len", "term", "tf")
    got = L.matched(docs, q, ("lang",))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and ("Aggregate" in plan) == twice
    beside, stats = rows(got, *names), rows(L.corpus_stats(docs, ("lang",)), "lang", "n", "avgdl")
    want = L.tokenized(docs, keep=("lang",)).groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(stats, key=key) == sorted(rows(want, "lang", "n", "avgdl"), key=key)
    monkeypatch.setattr(L, "known_terms", lambda terms: None)
    assert beside == rows(L.matched(docs, q, ("lang",)), *names) and len(beside) > 5


def test_fields_are_counted_beside_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, (t or "")[:9], t) for i, t in enumerate(TEXTS)], "doc_id long, title string, body string")
    q = spark.createDataFrame([(0, "the"), (0, "cat-a"), (1, "stra")], "query_id long, term string")
    got = rows(D.field_counts(docs, q), "seg", "term", "title_tf", "body_tf")
    assert "MapInArrow" in D.field_counts(docs, q)._jdf.queryExecution().toString()
    monkeypatch.setattr(D, "known_terms", lambda terms: None)
    assert got == rows(D.field_counts(docs, q), "seg", "term", "title_tf", "body_tf") and got


def test_norms_need_no_exchange_of_all_terms(spark):
    docs = spark.createDataFrame([(0, "a b b"), (1, "b c"), (2, None)], "doc_id long, text string")
    got = {r["seg"]: r["norm"] for r in L.tfidf_norms(docs).collect()}
    from math import log, sqrt

    assert got.keys() == {0, 1} and abs(got[0] - sqrt(log(3) ** 2 + (2 * log(1.5)) ** 2)) < 1e-12
    plan = L.tfidf_norms(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
