"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pytest

from skytally.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def rounded(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, duck):
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    ours = sorted([tuple(rounded(r[c]) for c in columns) for r in frame.collect()], key=str)
    relation = duck.sql(registry.ORACLES[name])
    names = list(relation.columns)
    theirs = sorted([tuple(rounded(r[names.index(c)]) for c in columns) for r in relation.fetchall()], key=str)
    assert sorted(names) == columns
    assert ours == theirs


def test_source_merge_all(spark, tmp_path):
    """Every network observation counts, whatever its id, and aircraft of one side alone stay."""
    rows = [(3, 1, 0), (6, 1, 9), (7, 1, 5), (8, 2, 1), (13, 2, 0), (9, 3, 0), (10, 4, 0), (14, 4, 1)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, hour int")
    events.selectExpr("event_id", "timestamp_seconds(1700000000 + hour * 3600) AS ts", "user_id", "'view' AS event_type", "1.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.icao_hex: (r.membership, r.altitude_ft, round(r.lat, 3)) for r in registry.QUERIES["source_merge_all"](spark, str(tmp_path)).collect()}
    place = lambda k: (k * 37 % 420 * 100, round(49 + k * 7919 % 2000 / 1000, 3))
    assert got == {"000001": ("overlap", *place(6)), "000002": ("network", *place(8)), "000003": ("local", *place(9)), "000004": ("network", *place(14))}


def test_stream_counts_every_event(spark, duck):
    counted = sum(r.available for r in registry.QUERIES["stream_hourly_counts"](spark, FOLDER).collect())
    assert counted == duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
