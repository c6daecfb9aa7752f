"""Every query with SQL gives the SQL's rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.catalog import ORACLES, QUERIES
from quarry.plans.flows import millis

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Each takes seconds even on the smallest tables; the others run all.
NAMES = sorted(ORACLES)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "NULL"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"{float(x) + 0.0:.6g}"
        return str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == canon(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    QUERIES[name](spark, sf).collect()


def test_delivery_times_to_the_millisecond(spark, sf, duck):
    """``canon`` keeps six digits of a number, which hides a millisecond."""
    df = QUERIES["delivery_schedule"](spark, sf)
    want = duck.sql(ORACLES["delivery_schedule"])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_halves_of_a_millisecond(spark, duck):
    micros = [-2501, -2500, -1500, -500, -499, 0, 499, 500, 1500, 2500, 1704067207179575, None]
    df = spark.createDataFrame([(x,) for x in micros], "us long")
    got = [r[0] for r in df.select(millis(F.timestamp_micros("us"))).collect()]
    assert got == [duck.execute("SELECT epoch_ms(make_timestamp(?::BIGINT))", [x]).fetchone()[0] for x in micros]
    assert got == [-3, -3, -2, -1, 0, 0, 0, 1, 2, 3, 1704067207180, None]
