"""The pipeline's stages on awkward and empty tables, and the contracts' columns against SQL."""

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string"
ROWS = [(1, "a plain text of some ten words that nobody else has here", "en", "s", 56, "k"), (2, None, None, None, None, None), (None, "", "en", "s", 0, "k"), (None, "no id but words of its own, seven or so", "en", "s", 40, "k"), (3, "x" * 300_000, "en", "s", 300_000, "k"), (4, "mail me at a.b@example.com", "en", "s", 26, None)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(name, stage, spark, sf):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = [*df.columns, "piece_ids"] if name == "pieces" else df.columns
    empty = stage(spark, df.limit(0), sf)
    assert empty.columns == want and empty.count() == 0
    out = stage(spark, df.union(df.filter("doc_id = 1")), sf)
    got = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in out.collect())
    rows = sorted((i or 0, len(t or "")) for i, t, *_ in [*ROWS, ROWS[0]])
    if name == "simhash":  # the null and the empty text are copies, and one of the repeated rows goes
        assert got == sorted(x for k, x in enumerate(rows) if x not in ((0, 0),) and (x != rows[k - 1] if k else True))
    elif name == "pii":
        assert got == sorted((i, len("mail me at [EMAIL]") if i == 4 else n) for i, n in rows)
    elif name != "toxicity":
        assert got == rows
    assert out.columns == want


@pytest.mark.parametrize("name", ["pii_counts", "license_base", "url_rules"])
def test_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    rows = [tuple(r) for r in queries.QUERIES[name](spark, sf).select(*want.columns).collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
