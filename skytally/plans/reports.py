"""Queries on feed records: normalisation, merging, sessions, ranges and text forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import reports
from ..sources.testdata import CALLS, OBSERVATIONS, RAW, ZONE, Frames
from .base import query

_NUMBER = r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"
NORMALISED = rf"""
raw AS ({RAW}), norm0 AS (
  SELECT *, upper(trim(hex)) AS icao, CASE WHEN regexp_full_match(trim(alt_baro), {_NUMBER}) THEN CAST(trim(alt_baro) AS DOUBLE) END AS baro,
    CASE WHEN alt_geom = '0x1F40' THEN 8000e0 WHEN regexp_full_match(alt_geom, {_NUMBER}) THEN CAST(alt_geom AS DOUBLE) END AS geom, lower(trim(kind)) AS k, lower(trim(ground)) AS g, lower(trim(emergency)) AS em,
    CASE WHEN seen >= 0 THEN seen END AS s, CASE WHEN seen_pos >= 0 THEN seen_pos END AS sp FROM raw
), norm AS (
  SELECT event_id, icao AS icao_hex, nullif(trim(flight), '') AS callsign,
    CASE WHEN k = 'mlat' THEN 'MLAT' WHEN k LIKE 'tisb%' THEN 'TIS-B' WHEN k = 'mode_s' THEN 'Mode-S' WHEN k LIKE 'adsb%' THEN 'ADS-B' WHEN mlat THEN 'MLAT' WHEN tisb THEN 'TIS-B' ELSE 'UNKNOWN' END AS source,
    coalesce(baro, geom) AS altitude_ft, CASE WHEN g IN ('true', 'ground') THEN true WHEN g = 'air' THEN false ELSE alt_baro = 'Ground' END AS on_ground,
    CASE WHEN em IN ('7700', '7600', 'lifeguard') THEN em END AS emergency, squawk, CASE WHEN lat <= 90 THEN lat END AS lat, lon, s AS seen, sp AS seen_pos,
    epoch_us(observed_at) - CAST(coalesce(s, 0) * 1000000 AS BIGINT) AS last_seen_us,
    epoch_us(observed_at) - CAST(coalesce(s, 0) * 1000000 AS BIGINT) + CAST((coalesce(s, 0) - sp) * 1000000 AS BIGINT) AS position_us, ground_speed, track, origin
  FROM norm0 WHERE regexp_full_match(icao, '~?[0-9A-F]{{6}}')
)"""
NORM = (OBSERVATIONS, NORMALISED)


@query("SELECT * FROM norm", NORM)
def normalised_records(x: Frames) -> DataFrame:
    return reports.normalised(x.raw())


@query("""
, l AS (SELECT * FROM norm WHERE origin = 'local' QUALIFY row_number() OVER (PARTITION BY icao_hex ORDER BY last_seen_us DESC, event_id DESC) = 1),
n AS (SELECT * FROM norm WHERE origin = 'network' QUALIFY row_number() OVER (PARTITION BY icao_hex ORDER BY last_seen_us DESC, event_id DESC) = 1),
j AS (SELECT l, n, greatest(coalesce(l.last_seen_us, 0), coalesce(n.last_seen_us, 0)) + 8000000 AS now_us FROM l FULL JOIN n ON l.icao_hex = n.icao_hex),
a AS (SELECT *, greatest((now_us - l.last_seen_us) / 1000e0, coalesce(l.seen, 0) * 1000) AS la, greatest((now_us - n.last_seen_us) / 1000e0, coalesce(n.seen, 0) * 1000) AS na,
  CASE WHEN l.lat IS NOT NULL THEN 1 WHEN n.lat IS NOT NULL AND n.seen_pos IS NOT NULL AND greatest(n.seen_pos * 1000, (now_us - n.position_us) / 1000e0) <= 30000 THEN 2 END AS place FROM j),
b AS (SELECT *, coalesce(place, CASE WHEN l.icao_hex IS NOT NULL THEN 1 ELSE 2 END) AS mv,
  l.emergency IS NOT NULL AND la <= 15000 AS le, n.emergency IS NOT NULL AND na <= 30000 AS ne, l.squawk IS NOT NULL AND la <= 15000 AS ls, n.squawk IS NOT NULL AND na <= 30000 AS ns FROM a),
c AS (SELECT *, CASE WHEN le AND ne AND la - na > 1000 THEN 2 WHEN le THEN 1 WHEN ne THEN 2 END AS e, CASE WHEN ls AND ns AND la - na > 1000 THEN 2 WHEN ls THEN 1 WHEN ns THEN 2 END AS q FROM b),
d AS (SELECT *, CASE e WHEN 1 THEN l.squawk WHEN 2 THEN n.squawk END AS es FROM c)
SELECT coalesce(l.icao_hex, n.icao_hex) AS icao_hex, CASE WHEN l.icao_hex IS NULL THEN 'network' WHEN n.icao_hex IS NULL THEN 'local' ELSE 'overlap' END AS membership, coalesce(l.callsign, n.callsign) AS callsign,
  CASE place WHEN 1 THEN 'local' WHEN 2 THEN 'network' END AS position_origin, CASE place WHEN 1 THEN l.lat WHEN 2 THEN n.lat END AS lat, CASE place WHEN 1 THEN l.lon WHEN 2 THEN n.lon END AS lon,
  CASE mv WHEN 1 THEN l.altitude_ft ELSE n.altitude_ft END AS altitude_ft, CASE mv WHEN 1 THEN l.ground_speed ELSE n.ground_speed END AS ground_speed, CASE mv WHEN 1 THEN l.source ELSE n.source END AS source,
  CASE mv WHEN 1 THEN l.on_ground ELSE n.on_ground END AS on_ground, CASE e WHEN 1 THEN l.emergency WHEN 2 THEN n.emergency END AS emergency,
  CASE WHEN es IN ('7500', '7600', '7700') THEN es ELSE CASE q WHEN 1 THEN l.squawk WHEN 2 THEN n.squawk END END AS squawk
FROM d""", NORM)
def source_merge_precedence(x: Frames) -> DataFrame:
    records = reports.normalised(x.raw())
    local, network = (reports.newest(records.where(F.col("origin") == o)) for o in ("local", "network"))
    now = F.greatest(F.coalesce("l_last_seen_us", F.lit(0)), F.coalesce("n_last_seen_us", F.lit(0))) + 8_000_000
    return reports.merge_feeds(local, network, now)


@query(f"""
, calls AS ({CALLS}), g AS (SELECT *, epoch_us(observed_at) AS us, coalesce(epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER w > 36000000000, false) AS gap FROM calls WINDOW w AS (PARTITION BY icao_hex ORDER BY observed_at, event_id)),
r AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) AS run FROM g),
k AS (SELECT *, coalesce(callsign <> last_value(callsign IGNORE NULLS) OVER (PARTITION BY icao_hex, run ORDER BY observed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS renamed FROM r),
s AS (SELECT *, sum(CAST(gap OR renamed AS INT)) OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) AS session FROM k),
f AS (SELECT icao_hex, CAST(session AS BIGINT) AS session, first(callsign ORDER BY us, event_id) FILTER (callsign IS NOT NULL) AS callsign, first(aircraft_type ORDER BY us, event_id) FILTER (aircraft_type IS NOT NULL) AS aircraft_type, count(*) AS positions,
  min(us) AS start_us, max(us) AS last_us, CASE WHEN count(*) = 1 THEN max(altitude_ft) ELSE nullif(max(coalesce(altitude_ft, 0)), 0) END AS max_altitude, min(distance_km) AS min_distance_km, first(renamed ORDER BY us, event_id) AS renamed FROM s GROUP BY 1, 2)
SELECT icao_hex, session, callsign, aircraft_type, positions, start_us, CASE WHEN lead(renamed) OVER w THEN lead(start_us) OVER w ELSE last_us END AS last_seen_us,
  CASE WHEN lead(renamed) OVER w THEN lead(start_us) OVER w WHEN lead(session) OVER w IS NOT NULL THEN last_us END AS end_us, max_altitude, min_distance_km FROM f WINDOW w AS (PARTITION BY icao_hex ORDER BY session)""", (OBSERVATIONS,))
def flight_sessions_exact(x: Frames) -> DataFrame:
    """The test tables have few reports a day, so the gap is ten hours here."""
    return reports.sessions(x.calls(), minutes=600)


_RANGES = {"today": ("2024-03-31 15:00:00", "2024-03-30 23:00:00"), "7d": ("2024-01-20 12:00:00", "2024-01-13 23:00:00"), "30d": ("2024-01-31 08:30:00", "2024-01-01 23:00:00"), "yesterday": ("2024-01-10 01:00:00", "2024-01-08 23:00:00")}


@query(" UNION ALL ".join(f"SELECT '{name}' AS range, count(*) AS positions, count(DISTINCT user_id) AS aircraft FROM events WHERE ts >= TIMESTAMP '{first}' AND ts {'<' if name == 'yesterday' else '<='} TIMESTAMP '{'2024-01-09 23:00:00' if name == 'yesterday' else now}'" for name, (now, first) in _RANGES.items()))
def local_ranges(x: Frames) -> DataFrame:
    """Today (over a change to summer time), 7d, 30d and yesterday, in local days."""
    events = x.table("events")
    part = lambda name, now: reports.in_range(events, "ts", name, now, ZONE).agg(F.lit(name).alias("range"), F.count("*").alias("positions"), F.countDistinct("user_id").alias("aircraft"))
    return reduce(DataFrame.unionByName, (part(name, now) for name, (now, _) in _RANGES.items()))


def texts(x: Frames, sql: str) -> DataFrame:
    """Rows (event_id, raw) whose text is put together from the observations' numbers."""
    return x.made(sql, obs=x.observations())


_MILES = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' || event_id % 12 WHEN 1 THEN ' ' || (1 + event_id % 3) || '/' || (2 + event_id % 7) || 'SM' WHEN 2 THEN (event_id % 9) || ' 1/' || (2 + event_id % 5) || ' sm' WHEN 3 THEN 'P' || event_id % 8 || 'SM' WHEN 4 THEN 'M1/' || event_id % 4 || 'SM' ELSE 'fog ' || event_id END AS raw FROM obs"


@query(f", t AS ({_MILES}) SELECT event_id, raw, CAST(round(CASE event_id % 6 WHEN 0 THEN event_id % 12 WHEN 1 THEN (1 + event_id % 3) / (2 + event_id % 7) WHEN 2 THEN event_id % 9 + 1 / (2 + event_id % 5) WHEN 3 THEN event_id % 8 WHEN 4 THEN 1 / nullif(event_id % 4, 0) END, 9) AS DOUBLE) AS miles FROM t", (OBSERVATIONS,))
def visibility_texts(x: Frames) -> DataFrame:
    return texts(x, _MILES).withColumn("miles", F.round(text.visibility_miles(F.col("raw")), 9))


_DEG, _MIN, _SEC = "(event_id * 7 % 92)", "(event_id * 11 % 62)", "(event_id * 13 % 60)"
_DMS = f"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN lpad('' || {_DEG}, 2, '0') || lpad('' || {_MIN}, 2, '0') || lpad('' || {_SEC}, 2, '0') || '.5' WHEN 1 THEN lpad('' || {_DEG}, 3, '0') || lpad('' || {_MIN}, 2, '0') || lpad('' || {_SEC}, 2, '0')
  ELSE ' ' || lpad('' || {_DEG}, 3, '0') || ' ' || lpad('' || {_MIN}, 2, '0') || '  ' || lpad('' || {_SEC}, 2, '0') || ',25 ' END || CASE event_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 's' WHEN 2 THEN 'E' ELSE 'W' END AS raw FROM obs"""
_SECONDS = f"({_SEC} + CASE event_id % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 0 ELSE 0.25e0 END)"


@query(f", t AS ({_DMS}), v AS (SELECT event_id, raw, {_DEG} + {_MIN} / 60e0 + {_SECONDS} / 3600e0 AS a FROM t) SELECT event_id, raw, round(CASE WHEN {_MIN} < 60 AND (event_id % 4 > 1 OR a <= 90) THEN CASE WHEN event_id % 4 IN (1, 3) THEN -a ELSE a END END, 9) AS degrees FROM v", (OBSERVATIONS,))
def coordinate_texts(x: Frames) -> DataFrame:
    return texts(x, _DMS).withColumn("degrees", F.round(text.dms_degrees(F.col("raw")), 9))


_AREA = "CASE event_id % 2 WHEN 0 THEN 'TRA' ELSE 'TSA' END"
_AREAS = f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'LK' || {_AREA} || event_id % 90 WHEN 1 THEN 'lk-' || lower({_AREA}) || ' ' || event_id % 90 || 'a' WHEN 2 THEN {_AREA} || ' ' || event_id % 90 || ' NAME' WHEN 3 THEN 'LZ' || {_AREA} || event_id % 90 WHEN 4 THEN {_AREA} || event_id % 80 || ' or LK' || {_AREA} || '_' || event_id % 90 WHEN 5 THEN {_AREA} || ' NAME ' || event_id ELSE {_AREA} || '/' || event_id % 90 || ' XYZ' END AS raw FROM obs"


@query(f", t AS ({_AREAS}) SELECT event_id, raw, CASE WHEN event_id % 7 IN (0, 1, 2, 4) THEN 'LK' || {_AREA} || event_id % 90 || CASE WHEN event_id % 7 = 1 THEN 'A' ELSE '' END END AS designator FROM t", (OBSERVATIONS,))
def airspace_designators(x: Frames) -> DataFrame:
    return texts(x, _AREAS).withColumn("designator", text.airspace_designator(F.col("raw")))


_LEVELS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'FL' || event_id % 700 WHEN 1 THEN 'fl ' || event_id % 90 WHEN 2 THEN event_id || ' ft AMSL' WHEN 3 THEN CASE event_id % 2 WHEN 0 THEN 'SFC' ELSE ' gnd ' END ELSE 'level ' || event_id END AS raw FROM obs"


@query(f", t AS ({_LEVELS}) SELECT event_id, raw, CAST(CASE event_id % 5 WHEN 0 THEN event_id % 700 * 100 WHEN 1 THEN event_id % 90 * 100 WHEN 2 THEN event_id WHEN 3 THEN 0 END AS INTEGER) AS feet FROM t", (OBSERVATIONS,))
def altitude_texts(x: Frames) -> DataFrame:
    return texts(x, _LEVELS).withColumn("feet", text.altitude_feet(F.col("raw")))


@query("SELECT event_id, trim(regexp_replace(regexp_replace('  a%b_ ' || event_type || '  x\\', '[\\\\%_]', '', 'g'), '\\s+', ' ', 'g')) AS term, event_type LIKE 'v%w' AS hit FROM events")
def search_terms(x: Frames) -> DataFrame:
    e = x.table("events")
    raw = F.concat(F.lit("  a%b_ "), "event_type", F.lit("  x\\"))
    return e.select("event_id", text.search_term(raw).alias("term"), F.col("event_type").rlike(text.wildcard("v*w")).alias("hit"))
