"""Streams over small tables of files, batch by batch."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skytally.streaming import flows

START = datetime(2024, 1, 1, 12)


@pytest.fixture
def stream(spark, tmp_path):
    """A stream whose batches are the given lists of rows."""

    def make(schema, *batches):
        folder = str(tmp_path / "in")
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        kind = spark.read.parquet(f"{folder}/0").schema
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")

    return make


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_hysteresis(stream):
    ticks = [("a", t, h) for t, h in enumerate([True, False, True, False, False, True, False, False, False, True])]
    rows = flows.run_to_end(flows.hysteresis(stream("key string, tick long, hit boolean", ticks[:4], ticks[4:])))
    assert sorted((r.tick, r.change) for r in rows.collect()) == [(2, "opened"), (8, "closed")]


def test_drop_guard(stream):
    counts = [30, 31, 10, 9, 40, 15, 39, 10, 4]
    rows = flows.run_to_end(flows.drop_guard(stream("origin string, tick long, aircraft long", [("local", t, n) for t, n in enumerate(counts)])))
    assert [r.decision for r in sorted(rows.collect(), key=lambda r: r.tick)] == ["pruned", "pruned", "deferred", "confirmed", "pruned", "deferred", "recovered", "deferred", "confirmed"]


def test_last_known(stream):
    rows = [[("A", at(0), 100), ("A", at(1), None), ("B", at(0), 7)], [("A", at(0.5), 900), ("C", at(60), 1)], [("C", at(61), 2)]]
    out = flows.run_to_end(flows.last_known(stream("icao_hex string, observed_at timestamp, altitude_ft long", *rows)), "update").collect()
    assert {r.icao_hex for r in out if r.gone} >= {"B"}
    assert {r.altitude_ft for r in out if r.icao_hex == "A" and not r.gone} == {100}


def test_once_and_fresh(stream):
    rows = [[(1, at(0), "local"), (1, at(1), "local"), (2, at(1), "network")], [(2, at(2), "network"), (3, at(3), "local")]]
    feed = stream("uid long, observed_at timestamp, origin string", *rows)
    assert sorted(r.uid for r in flows.run_to_end(flows.once(feed, "uid")).collect()) == [1, 2, 3]
    kept = flows.run_to_end(flows.fresh(feed, F.lit(at(3)).cast("timestamp"), {"local": 60, "network": 120}))
    assert sorted((r.uid, r.origin) for r in kept.collect()) == [(2, "network"), (2, "network"), (3, "local")]


def test_batches_replace_themselves(spark, tmp_path):
    for n in (5, 7):
        flows.write_once(spark.range(n), 3, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == 7
