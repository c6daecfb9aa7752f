"""Intervals of events, at times that the small tables do not hold."""

import datetime

import duckdb
import pytest

from quarry.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["interval_merge", "evidence_coverage"])
def test_minutes_are_those_of_the_sql(name, spark, tmp_path):
    """Half a millisecond before a minute belongs to that minute; minutes before 1970 are cut towards zero."""
    times = ["2024-01-01 00:00:59.999499", "2024-01-01 00:00:59.999500", "2024-01-01 00:00:59.999999", "2024-01-01 00:01:00", "1969-12-31 23:59:29.5", "1969-12-31 20:58:59.9996", "1969-12-31 23:57:00"]
    rows = [(n, n, datetime.datetime.fromisoformat(t)) for n, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
