"""Queries of the coverage and integrity chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, integrity, receiver, reports
from ..sources.testdata import FLIGHTS, OBSERVATIONS, SIGNALS, ZONE, Frames
from .base import query
from .reports import NORM

NOW = "2024-01-20 00:00:00"
_AZ = "least(35, CAST(floor(bearing / 10) AS BIGINT))"
HOURLY = f"""
hourly AS (SELECT hour, bucket, count(*) AS available, CAST(sum(captured) AS BIGINT) AS captured, list_sort(list(DISTINCT event_type)) AS providers FROM (
  SELECT date_trunc('hour', observed_at) AS hour, CAST(origin = 'local' AS INT) AS captured, event_type, unnest(['overall', 'azimuth:' || {_AZ}]) AS bucket FROM obs WHERE distance_km BETWEEN 0 AND 1000) GROUP BY 1, 2)"""
HOUR = (OBSERVATIONS, HOURLY)
_AGO = lambda a, b: f"hour >= TIMESTAMP '{NOW}' - INTERVAL {a} HOUR AND hour < TIMESTAMP '{NOW}' - INTERVAL {b} HOUR"


def _ratio(a: int, b: int, least: int) -> str:
    available, captured = (f"coalesce(sum({c}) FILTER ({_AGO(a, b)}), 0)" for c in ("available", "captured"))
    return f"CASE WHEN {available} >= {least} THEN least({available}, {captured}) / CAST({available} AS DOUBLE) END"


_SECTORS = f"""
sec AS (SELECT CAST(substring(bucket, 9) AS BIGINT) AS sector, {_ratio(24, 0, 40)} AS c, {_ratio(192, 24, 200)} AS b FROM hourly WHERE bucket LIKE 'azimuth:%' AND {_AGO(192, 0)} GROUP BY 1),
sectors AS (SELECT CAST(i AS BIGINT) AS sector, round(c, 6) AS current, round(b, 6) AS baseline, round((c - b) * 100, 6) AS delta,
  CASE WHEN c - b IS NULL THEN 'INSUFFICIENT_DATA' WHEN (c - b) * 100 <= -15 AND (b > 0 AND c / b < 0.75) THEN 'DEGRADED' WHEN (c - b) * 100 >= 15 AND c > b THEN 'IMPROVED' ELSE 'GOOD' END AS state FROM range(36) r(i) LEFT JOIN sec ON sector = i)"""


@query("SELECT bucket, CAST(sum(available) AS BIGINT) AS available, CAST(sum(captured) AS BIGINT) AS captured, array_to_string(list_sort(list_distinct(flatten(list(providers)))), ',') AS providers, round(least(sum(captured), sum(available)) * 100e0 / sum(available), 6) AS percent FROM hourly GROUP BY 1", HOUR)
def historical_coverage(x: Frames) -> DataFrame:
    return coverage.roll_up(coverage.hourly_capture(x.observations()))


@query("SELECT hour, bucket, available, captured, array_to_string(providers, ',') AS providers FROM hourly", HOUR)
def coverage_upsert(x: Frames) -> DataFrame:
    """Counts of the first half of January as stored, those after as the delta."""
    obs = x.observations()
    part = lambda cond: coverage.hourly_capture(obs.where(cond))
    at = F.lit("2024-01-15 10:30:00").cast("timestamp")
    merged = coverage.merge_counts(part(F.col("observed_at") < at), part(F.col("observed_at") >= at))
    return merged.withColumn("providers", F.array_join("providers", ","))


@query(f", {_SECTORS} SELECT * FROM sectors", HOUR)
def coverage_health_sectors(x: Frames) -> DataFrame:
    return coverage.sector_health(coverage.hourly_capture(x.observations()), NOW)


@query(f""", {_SECTORS},
a AS (SELECT {_ratio(24, 0, 120)} AS c, {_ratio(192, 24, 800)} AS b, {_ratio(6, 0, 30)} AS l, {_ratio(24, 6, 90)} AS p FROM hourly WHERE bucket = 'overall' AND {_AGO(192, 0)}),
s AS (SELECT count(*) FILTER (state = 'DEGRADED') AS degraded, count(*) FILTER (state = 'IMPROVED') AS improved, count(*) FILTER (state <> 'INSUFFICIENT_DATA') AS evaluated FROM sectors)
SELECT round(c, 6) AS current, round(b, 6) AS baseline, round(l, 6) AS last6h, round(p, 6) AS previous18h, degraded, improved, evaluated,
  CASE WHEN c IS NULL OR b IS NULL OR evaluated < 8 THEN 'INSUFFICIENT_DATA' WHEN NOT (coalesce((c - b) * 100 <= -10, false) OR degraded >= 3) THEN 'GOOD' WHEN coalesce(l - p >= 0.08, false) THEN 'RECOVERING' ELSE 'DEGRADED' END AS state FROM a, s""", HOUR)
def coverage_health_v2(x: Frames) -> DataFrame:
    return coverage.rolling_health(coverage.hourly_capture(x.observations()), NOW)


_REACH = f"reach AS (SELECT day, {_AZ} AS sector, max(distance_km) AS reach FROM obs WHERE distance_km > 0 AND distance_km <= 1000 GROUP BY 1, 2)"
_MESSAGES = "msg AS (SELECT day, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN raw_messages < p THEN raw_messages ELSE raw_messages - p END) AS BIGINT) AS messages FROM (SELECT *, lag(raw_messages) OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) AS p FROM obs) GROUP BY day)"


@query(f""", {_REACH}, {_MESSAGES},
d AS (SELECT day, median(reach) AS range, count(*) AS sectors, any_value(aircraft) AS aircraft, any_value(messages) AS messages FROM reach JOIN (SELECT day, count(DISTINCT icao_hex) AS aircraft FROM obs GROUP BY 1) USING (day) LEFT JOIN msg USING (day) GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY day DESC) - 1 AS back FROM d WHERE day < '2024-01-20' AND sectors >= 12 QUALIFY back <= 7),
r AS (SELECT max(day) FILTER (back = 0) AS day, count(*) FILTER (back > 0) AS baseline_days, {', '.join(f"max({c}) FILTER (back = 0) / median({c}) FILTER (back > 0 AND {c} > 0) AS {c}" for c in ('range', 'sectors', 'aircraft', 'messages'))} FROM k)
SELECT day, baseline_days, {', '.join(f"round(CASE WHEN baseline_days >= 3 THEN {c} END, 6) AS {c}_ratio" for c in ('range', 'sectors', 'aircraft', 'messages'))},
  CASE WHEN day IS NULL OR baseline_days < 3 THEN 'INSUFFICIENT_DATA' WHEN coalesce(range < 0.55, false) OR coalesce(sectors < 0.5, false) OR CAST(coalesce(range < 0.75, false) AS INT) + CAST(coalesce(sectors < 0.75, false) AS INT) + CAST(coalesce(messages < 0.6, false) AS INT) >= 2 THEN 'DEGRADED' ELSE 'GOOD' END AS state FROM r""", (OBSERVATIONS,))
def coverage_health_v1(x: Frames) -> DataFrame:
    obs = x.observations()
    return coverage.daily_health(obs, receiver.message_totals(obs), "2024-01-20")


@query(f""", {_REACH},
p AS (SELECT sector, count(*) AS days, median(reach) AS m, quantile_disc(reach, 0.95) AS p95_km, quantile_disc(reach, 0.99) AS p99_km, max(reach) AS max_km FROM reach WHERE day BETWEEN '2024-01-01' AND '2024-01-30' GROUP BY 1)
SELECT sector, days, round(days * 100 / 30e0, 1) AS percent, round(m, 6) AS median_km, p95_km, p99_km, max_km, days >= 15 AS reliable, days >= 15 AND row_number() OVER (ORDER BY days >= 15 DESC, m DESC, sector) = 1 AS best FROM p""", (OBSERVATIONS,))
def best_reliable_sector(x: Frames) -> DataFrame:
    return coverage.reliable_sectors(x.observations().where("day BETWEEN '2024-01-01' AND '2024-01-30'"), 30)


@query(f"SELECT band, quantile_disc(reach, 0.95) AS p95_km, max(reach) AS max_km, count(DISTINCT day) AS days FROM (SELECT CAST(CASE WHEN altitude_ft < 5000 THEN 0 WHEN altitude_ft < 15000 THEN 1 WHEN altitude_ft < 30000 THEN 2 ELSE 3 END AS BIGINT) AS band, day, {_AZ} AS sector, max(distance_km) AS reach FROM obs WHERE distance_km > 0 AND distance_km <= 1000 GROUP BY 1, 2, 3) GROUP BY 1", (OBSERVATIONS,))
def altitude_band_sectors(x: Frames) -> DataFrame:
    return coverage.altitude_band_sectors(x.observations())


@query(f", {_MESSAGES} SELECT 'january' AS range, CAST(sum(messages) AS BIGINT) AS messages, count(messages) AS days FROM msg WHERE day LIKE '2024-01%' UNION ALL SELECT 'none', CAST(sum(messages) AS BIGINT), count(messages) FROM msg WHERE day LIKE '1999%'", (OBSERVATIONS,))
def messages_total(x: Frames) -> DataFrame:
    days = receiver.message_totals(x.observations())
    part = lambda name, start: coverage.total_messages(days.where(F.col("day").startswith(start))).withColumn("range", F.lit(name))
    return part("january", "2024-01").unionByName(part("none", "1999"))


_HOURS = "SELECT strftime(date_trunc('hour', (start_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague'), '%Y-%m-%d %H') AS hour, count(*) AS flights FROM fl WHERE start_time >= TIMESTAMP '1995-06-01' AND start_time < TIMESTAMP '1995-07-01' GROUP BY 1"


@query(f"SELECT CAST(sum(flights) AS BIGINT) AS all, CASE WHEN sum(flights) <= 20000 THEN arg_max(hour, (flights, -epoch(strptime(hour, '%Y-%m-%d %H')))) END AS hour, CASE WHEN sum(flights) <= 20000 THEN max(flights) END AS flights FROM ({_HOURS})".replace(" AS all,", ' AS "all",'), (FLIGHTS,))
def busiest_hour(x: Frames) -> DataFrame:
    june = (F.col("start_time") >= F.lit("1995-06-01").cast("timestamp")) & (F.col("start_time") < F.lit("1995-07-01").cast("timestamp"))
    return coverage.busiest_hour(x.flights().where(june), ZONE)


@query("""
, k AS (SELECT icao_hex, max(CASE WHEN origin = 'local' THEN 1 ELSE 0 END) AS l, max(CASE WHEN origin = 'network' THEN 1 ELSE 0 END) AS n FROM norm GROUP BY 1)
SELECT count(*) FILTER (l = 1) AS local, count(*) FILTER (n = 1) AS network, count(*) FILTER (l = 1 AND n = 1) AS overlap, count(*) FILTER (n = 0) AS local_only, count(*) FILTER (l = 0) AS network_only, count(*) AS total FROM k""", NORM)
def source_statistics(x: Frames) -> DataFrame:
    records = reports.normalised(x.raw())
    local, network = (reports.newest(records.where(F.col("origin") == o)) for o in ("local", "network"))
    return coverage.source_counts(reports.merge_feeds(local, network, F.lit(0)))


@query("""
, f AS (SELECT * FROM obs WHERE observed_at BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 12:00:00'),
n AS (SELECT icao_hex, distance_km, bearing, altitude_ft FROM f WHERE origin = 'network' AND NOT regexp_full_match(icao_hex, '~.*|0+') QUALIFY row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at DESC, event_id DESC) = 1)
SELECT icao_hex, distance_km, bearing, altitude_ft, icao_hex IN (SELECT icao_hex FROM f WHERE origin = 'local') AS captured FROM n WHERE distance_km <= 50 * 1.852e0""", (OBSERVATIONS,))
def coverage_eligibility(x: Frames) -> DataFrame:
    obs = x.observations()
    return coverage.eligible(obs.where("origin = 'network'"), obs.where("origin = 'local'"), "2024-01-15 12:00:00", 50, 43_200)


_LOW = {"nic": 5, "nac_p": 6, "nac_v": 2, "sil": 1, "sda": 1, "gva": 2}
_N = " + ".join(f"CASE WHEN {c} <= {v} THEN 1 ELSE 0 END" for c, v in _LOW.items())
STATES = f"""
sig AS ({SIGNALS}), low AS (SELECT *, {_N} AS n_low FROM sig),
cell AS (SELECT *, CAST(floor(lat / 0.2e0) AS BIGINT) AS lat_cell, CAST(floor(lon / 0.2e0) AS BIGINT) AS lon_cell, CAST(CASE WHEN altitude_ft < 10000 THEN 0 WHEN altitude_ft < 20000 THEN 1 WHEN altitude_ft < 30000 THEN 2 WHEN altitude_ft < 40000 THEN 3 ELSE 4 END AS BIGINT) AS band,
  CASE WHEN n_low = 0 THEN 'NORMAL' WHEN n_low >= 3 OR (nic <= 3 AND sil <= 1) THEN 'SEVERE' WHEN n_low = 2 THEN 'DEGRADED' ELSE 'REDUCED' END AS state,
  coalesce(nic <= 5, false) OR coalesce(nac_p <= 6, false) OR coalesce(nac_v <= 2, false) AS is_low FROM low)"""
SIG = (OBSERVATIONS, STATES)


@query("SELECT event_id, CAST(n_low AS INT) AS n_low, state FROM cell", SIG)
def ni_classification(x: Frames) -> DataFrame:
    return x.signals().select("event_id", integrity.low_fields().alias("n_low"), integrity.state().alias("state"))


@query("""
SELECT event_id, CASE WHEN seen_pos IS NULL OR seen_pos > 45 THEN 'stale_position' WHEN on_ground THEN 'on_ground' WHEN coalesce(nic, nac_p, nac_v, sil, sda, gva) IS NULL THEN 'no_integrity_fields' WHEN telemetry_age > 90 THEN 'stale_integrity' WHEN abs(telemetry_age - seen_pos) > 60 THEN 'position_integrity_skew' END AS reason FROM sig""", SIG)
def ni_rejections(x: Frames) -> DataFrame:
    return x.signals().select("event_id", integrity.rejection(F.col("seen_pos"), F.col("telemetry_age"), most_skew=60).alias("reason"))


_CONFIDENCE = "CASE WHEN {a} >= 5 OR ({a} >= 3 AND {l} >= 3 AND {d} >= 120) THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"""
, p AS (SELECT lat_cell, lon_cell, band, count(*) AS samples, count(DISTINCT icao_hex) AS aircraft, count(DISTINCT icao_hex) FILTER (source = 'LOCAL') AS local, count(DISTINCT icao_hex) FILTER (source = 'NETWORK') AS network, count(DISTINCT icao_hex) FILTER (state <> 'NORMAL') AS affected,
  median(nic) AS median_nic, median(nac_p) AS median_nac_p, max(list_position(['NORMAL', 'REDUCED', 'DEGRADED', 'SEVERE'], state)) AS worst FROM cell GROUP BY 1, 2, 3)
SELECT * EXCLUDE (worst), list_extract(['NORMAL', 'REDUCED', 'DEGRADED', 'SEVERE'], worst) AS state, {_CONFIDENCE.format(a='affected', l='local', d='0')} AS confidence FROM p""", SIG)
def ni_cells(x: Frames) -> DataFrame:
    return integrity.cells(x.signals())


@query("""
, p AS (SELECT lat_cell, lon_cell, band, count(*) AS samples, count(DISTINCT icao_hex) AS aircraft, count(DISTINCT floor(epoch(observed_at) / 900)) AS buckets, median(nic) AS median_nic, median(nac_p) AS median_nac_p, median(nac_v) AS median_nac_v, round(count(*) FILTER (is_low) / CAST(count(*) AS DOUBLE), 6) AS low_share FROM cell GROUP BY 1, 2, 3)
SELECT *, CASE WHEN aircraft >= 8 AND samples >= 20 AND buckets >= 6 THEN 'STRONG' WHEN aircraft >= 5 AND samples >= 20 AND buckets >= 3 THEN 'READY' WHEN aircraft >= 3 AND samples >= 6 THEN 'PARTIAL' ELSE 'IMMATURE' END AS maturity FROM p""", SIG)
def ni_baseline_maturity(x: Frames) -> DataFrame:
    return integrity.baseline(x.signals())


_GROUPS = """
nodes AS (SELECT DISTINCT lat_cell, lon_cell, band, lpad(CAST(lat_cell + 100000 AS VARCHAR), 6, '0') || ':' || lpad(CAST(lon_cell + 100000 AS VARCHAR), 6, '0') || ':' || band AS node FROM cell WHERE {of}),
reach AS (SELECT node, node AS leader FROM nodes UNION SELECT b.node, r.leader FROM reach r JOIN nodes a ON a.node = r.node JOIN nodes b ON b.band = a.band AND abs(b.lat_cell - a.lat_cell) <= 1 AND abs(b.lon_cell - a.lon_cell) <= 1 WHERE r.leader < b.node),
grp AS (SELECT lat_cell, lon_cell, band, min(leader) AS leader FROM nodes JOIN reach USING (node) GROUP BY 1, 2, 3)"""
_REC = (OBSERVATIONS.replace("obs0 AS", "RECURSIVE obs0 AS", 1), STATES)


@query(f", {_GROUPS.format(of='n_low >= 4')} SELECT * FROM grp", _REC)
def ni_cell_groups(x: Frames) -> DataFrame:
    return integrity.groups(integrity.celled(x.signals()).where(integrity.low_fields() >= 4))


@query(f""", {_GROUPS.format(of="state <> 'NORMAL'")},
b AS (SELECT cell.*, leader FROM cell JOIN grp USING (lat_cell, lon_cell, band) WHERE state <> 'NORMAL'),
p AS (SELECT leader, count(DISTINCT (lat_cell, lon_cell, band)) AS cells, count(*) AS samples, count(DISTINCT icao_hex) AS aircraft, count(DISTINCT icao_hex) FILTER (source = 'LOCAL') AS local, count(DISTINCT icao_hex) FILTER (source = 'NETWORK') AS network, median(nic) AS median_nic, median(nac_p) AS median_nac_p,
  round(count(*) FILTER (is_low) / CAST(count(*) AS DOUBLE), 6) AS low_share, CAST(floor(epoch(max(observed_at))) - floor(epoch(min(observed_at))) AS BIGINT) AS duration_s, max(list_position(['REDUCED', 'DEGRADED', 'SEVERE'], state)) AS worst FROM b GROUP BY 1 HAVING count(DISTINCT icao_hex) >= 3),
o AS (SELECT leader, max(n) AS most FROM (SELECT leader, icao_hex, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT leader, count(DISTINCT icao_hex) AS normal_aircraft FROM cell JOIN grp USING (lat_cell, lon_cell, band) WHERE state = 'NORMAL' GROUP BY 1)
SELECT p.* EXCLUDE (worst), list_extract(['REDUCED', 'DEGRADED', 'SEVERE'], worst) AS severity, coalesce(normal_aircraft, 0) AS normal_aircraft, most / CAST(samples AS DOUBLE) > 0.5 AS one_aircraft,
  CASE WHEN aircraft >= 8 AND local >= 3 AND duration_s >= 300 THEN 'HIGH' ELSE {_CONFIDENCE.format(a='aircraft', l='local', d='duration_s')} END AS confidence FROM p JOIN o USING (leader) LEFT JOIN g USING (leader)""", _REC)
def ni_candidates(x: Frames) -> DataFrame:
    return integrity.candidates(x.signals())


@query("SELECT field, CAST(value AS BIGINT) AS value, count(*) AS samples FROM (SELECT unnest(['nic', 'nac_p', 'nac_v', 'sil', 'sda', 'gva']) AS field, unnest([nic, nac_p, nac_v, sil, sda, gva]) AS value FROM sig) GROUP BY 1, 2", SIG)
def ni_quality(x: Frames) -> DataFrame:
    return integrity.quality(x.signals())
