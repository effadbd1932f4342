"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from ..sources.testdata import Frames
from ..streaming import flows
from .base import query


def _events(x: Frames) -> DataFrame:
    """The events as a stream of files."""
    schema = x.table("events").schema
    e = x.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(x.folder)
    return e.select("event_id", F.lpad(F.hex("user_id"), 6, "0").alias("icao_hex"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_type").alias("bucket"), (F.col("event_id") % 3 == 0).cast("long").alias("captured"), (F.col("event_id") * 37 % 420 * 100).alias("altitude_ft"))


#: What a stream in append mode has given when its input ends: what ended before the watermark; state behind it is gone.
_CLOSED = "(SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)"


@query("SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type AS bucket, count(*) AS available, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS captured FROM events GROUP BY 1, 2")
def stream_hourly_counts(x: Frames) -> DataFrame:
    """All hours, the last one too; the state is a row an hour and bucket."""
    return flows.run_to_end(flows.hourly_counts(_events(x)), "complete").select(F.unix_micros("hour").alias("hour_us"), "bucket", "available", "captured")


@query(f"""
WITH w AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (SELECT user_id, event_id, epoch_us(ts) AS us, event_id * 37 % 420 * 100 AS alt, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT * FROM (SELECT upper(lpad(to_hex(user_id), 6, '0')) AS icao_hex, min(us) AS start_us, max(us) AS end_us, count(*) AS positions, nullif(max(alt), 0) AS max_altitude FROM w GROUP BY user_id, s) WHERE end_us + 600000001 <= {_CLOSED}""")
def stream_gap_flights(x: Frames) -> DataFrame:
    """The flights that are over."""
    out = flows.run_to_end(flows.gap_flights(_events(x)))
    return out.select("icao_hex", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "positions", "max_altitude")


def _stream(x: Frames, rows: DataFrame) -> DataFrame:
    """A stream over a table that is written first."""
    stored = cut_lineage(rows)
    return x.spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])


@query("""
WITH RECURSIVE t AS (SELECT CAST(user_id % 3 AS VARCHAR) AS origin, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS tick, count(DISTINCT user_id) AS aircraft FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY tick) AS i FROM t),
w AS (SELECT origin, tick, i, aircraft AS base, false AS waiting, 'pruned' AS decision FROM k WHERE i = 1
  UNION ALL SELECT origin, tick, i, CASE WHEN d AND NOT was THEN base ELSE aircraft END, d AND NOT was, CASE WHEN d AND NOT was THEN 'deferred' WHEN was AND d THEN 'confirmed' WHEN was THEN 'recovered' ELSE 'pruned' END
  FROM (SELECT k.*, w.base, w.waiting AS was, w.base >= 20 AND k.aircraft <= w.base * 0.95e0 AS d FROM w JOIN k ON k.origin = w.origin AND k.i = w.i + 1) z)
SELECT origin, tick, decision FROM w""")
def stream_drop_guard(x: Frames) -> DataFrame:
    """The decision on each daily snapshot, sized by its aircraft; a twentieth fewer is a drop here."""
    ship_package(x.spark)
    e = x.table("events")
    days = e.groupBy((F.col("user_id") % 3).cast("string").alias("origin"), F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("tick")).agg(F.countDistinct("user_id").alias("aircraft"))
    return flows.run_to_end(flows.drop_guard(_stream(x, days), share=0.05))


@query("""
WITH RECURSIVE t AS (SELECT event_type AS key, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS tick, avg(value) > 50 AS hit FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tick) AS i FROM t),
w AS (SELECT key, tick, i, CAST(hit AS INT) AS hits, CAST(NOT hit AS INT) AS misses, false AS open, CAST(NULL AS VARCHAR) AS change FROM k WHERE i = 1
  UNION ALL SELECT key, tick, i, CASE WHEN was AND m >= 3 THEN 0 ELSE h END, CASE WHEN was AND m >= 3 THEN 0 ELSE m END, CASE WHEN was THEN m < 3 ELSE h >= 2 END, CASE WHEN NOT was AND h >= 2 THEN 'opened' WHEN was AND m >= 3 THEN 'closed' END
  FROM (SELECT k.key, k.tick, k.i, w.open AS was, w.hits + CAST(k.hit AS INT) AS h, CASE WHEN k.hit THEN 0 ELSE w.misses + 1 END AS m FROM w JOIN k ON k.key = w.key AND k.i = w.i + 1) z)
SELECT key, tick, change FROM w WHERE change IS NOT NULL""")
def stream_anomalies(x: Frames) -> DataFrame:
    """When anomalies of each kind of event open and close, by hours of a high mean."""
    ship_package(x.spark)
    e = x.table("events")
    hours = e.groupBy(F.col("event_type").alias("key"), F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("tick")).agg((F.avg("value") > 50).alias("hit"))
    return flows.run_to_end(flows.hysteresis(_stream(x, hours)))
