"""Registered queries over the derived frames, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.buckets import azimuth
from ..operators import receiver, sequences, traffic
from ..sources.testdata import FLIGHTS, OBSERVATIONS, ZONE, Frames, local_day
from .base import ORACLES, QUERIES, query

OBS, FLT = (OBSERVATIONS,), (FLIGHTS,)
_AZ = "least(35, CAST(floor(bearing / 10) AS BIGINT))"


def _ranking(column: str, table: str = "fl") -> str:
    return f"SELECT upper(trim({column})) AS name, count(*) AS flights FROM {table} WHERE trim({column}) <> '' GROUP BY 1 ORDER BY flights DESC, name LIMIT 8"


@query(_ranking("aircraft_type"), FLT)
def traffic_top_types(x: Frames) -> DataFrame:
    return traffic.top_names(x.flights(), F.col("aircraft_type"))


@query(_ranking("airline"), FLT)
def traffic_top_airlines(x: Frames) -> DataFrame:
    return traffic.top_names(x.flights(), F.col("airline"))


@query(_ranking("origin"), FLT)
def traffic_top_origins(x: Frames) -> DataFrame:
    return traffic.top_names(x.flights(), F.col("origin"))


@query(_ranking("destination"), FLT)
def traffic_top_destinations(x: Frames) -> DataFrame:
    return traffic.top_names(x.flights(), F.col("destination"))


@query("SELECT origin, destination, count(*) AS flights FROM fl GROUP BY 1, 2 ORDER BY flights DESC, origin, destination LIMIT 8", FLT)
def traffic_top_routes(x: Frames) -> DataFrame:
    return traffic.top_routes(x.flights())


@query("SELECT upper(operator) AS name, count(*) AS flights FROM fl JOIN air USING (aircraft_id) GROUP BY 1 ORDER BY flights DESC, name LIMIT 8", FLT)
def traffic_operators(x: Frames) -> DataFrame:
    return traffic.with_aircraft(x.flights(), x.aircraft(), F.col("operator"))


@query("SELECT upper(CASE WHEN upper(country) = country_code THEN country ELSE country_code || ' · ' || country END) AS name, count(*) AS flights FROM fl JOIN air USING (aircraft_id) GROUP BY 1 ORDER BY flights DESC, name LIMIT 8", FLT)
def traffic_countries(x: Frames) -> DataFrame:
    return traffic.with_aircraft(x.flights(), x.aircraft(), traffic.country_label())


_DAILY = """
SELECT day, count(DISTINCT icao_hex) AS unique_aircraft, max(CASE WHEN distance_km BETWEEN 0 AND 1000 THEN distance_km END) AS max_distance_km,
  (SELECT max(n) FROM (SELECT count(DISTINCT icao_hex) AS n FROM obs i WHERE i.day = o.day GROUP BY date_trunc('hour', observed_at))) AS max_concurrent
FROM obs o GROUP BY day"""


@query(_DAILY, OBS)
def daily_receiver_stats(x: Frames) -> DataFrame:
    return receiver.daily_stats(x.observations())


@query(f"SELECT strftime(d, '%Y-%m-%d') AS day, unique_aircraft, max_distance_km, max_concurrent FROM generate_series(DATE '2023-12-28', DATE '2024-02-05', INTERVAL 1 DAY) s(d) LEFT JOIN ({_DAILY}) t ON t.day = strftime(d, '%Y-%m-%d')", OBS)
def daily_trend_spine(x: Frames) -> DataFrame:
    return receiver.trend(x.observations("2023-12-27", "2024-02-07"), "2023-12-28", "2024-02-05")


@query("SELECT CASE WHEN day BETWEEN '2024-01-15' AND '2024-01-21' THEN 'current' ELSE 'previous' END AS period, count(DISTINCT icao_hex) AS unique_aircraft, count(*) AS positions, max(distance_km) AS max_distance_km FROM obs WHERE day BETWEEN '2024-01-08' AND '2024-01-21' GROUP BY 1", OBS)
def period_comparison(x: Frames) -> DataFrame:
    return receiver.period_comparison(x.observations("2024-01-07", "2024-01-23"), "2024-01-15", "2024-01-21")


@query(f"SELECT CAST(i AS BIGINT) AS azimuth, coalesce(m, 0e0) AS max_distance_km FROM range(36) r(i) LEFT JOIN (SELECT {_AZ} AS a, max(distance_km) AS m FROM obs WHERE distance_km BETWEEN 0 AND 1000 GROUP BY 1) ON a = i", OBS)
def azimuth_coverage(x: Frames) -> DataFrame:
    return receiver.azimuth_coverage(x.observations())


@query(f"SELECT {_AZ} AS azimuth, CAST(CASE WHEN altitude_ft < 5000 THEN 0 WHEN altitude_ft < 15000 THEN 1 WHEN altitude_ft < 30000 THEN 2 ELSE 3 END AS BIGINT) AS band, max(distance_km) AS max_distance_km FROM obs WHERE distance_km BETWEEN 0 AND 1000 GROUP BY 1, 2", OBS)
def altitude_azimuth_coverage(x: Frames) -> DataFrame:
    return receiver.altitude_coverage(x.observations())


@query(f"SELECT max(m) AS max_km, count(*) FILTER (WHERE m > 0) AS populated, round(avg(m) FILTER (WHERE m > 0), 6) AS mean_km, CAST(arg_min(a * 10 + 5, -m * 1000 + a) AS DOUBLE) AS best_bearing FROM (SELECT {_AZ} AS a, max(distance_km) AS m FROM obs WHERE distance_km BETWEEN 0 AND 1000 GROUP BY 1)", OBS)
def coverage_summary(x: Frames) -> DataFrame:
    sectors = receiver.azimuth_coverage(x.observations())
    full = F.when(F.col("max_distance_km") > 0, F.col("max_distance_km"))
    return sectors.agg(F.max("max_distance_km").alias("max_km"), F.count(full).alias("populated"), F.round(F.avg(full), 6).alias("mean_km"), F.min_by(F.col("azimuth") * 10.0 + 5, -F.col("max_distance_km") * 1000 + F.col("azimuth")).alias("best_bearing"))


@query(f"SELECT azimuth, count(*) AS days, round(median(reach), 6) AS median_km, quantile_disc(reach, 0.95) AS p95_km, max(reach) AS max_km FROM (SELECT day, {_AZ} AS azimuth, max(distance_km) AS reach FROM obs WHERE distance_km BETWEEN 0 AND 1000 GROUP BY 1, 2) GROUP BY 1", OBS)
def sector_percentiles(x: Frames) -> DataFrame:
    return receiver.sector_percentiles(x.observations())


@query("SELECT day, icao_hex, ground_speed, event_id FROM obs WHERE ground_speed BETWEEN 30 AND 700 QUALIFY row_number() OVER (PARTITION BY day ORDER BY ground_speed DESC, observed_at, event_id) = 1", OBS)
def fastest_record(x: Frames) -> DataFrame:
    return receiver.fastest(x.observations())


@query("SELECT day, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN raw_messages < p THEN raw_messages ELSE raw_messages - p END) AS BIGINT) AS messages FROM (SELECT *, lag(raw_messages) OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) AS p FROM obs) GROUP BY day", OBS)
def message_counter_resets(x: Frames) -> DataFrame:
    return receiver.message_totals(x.observations())


@query(f"""
, r AS (SELECT CAST(origin = 'local' AS BIGINT) AS captured, {_AZ} AS az,
  CASE WHEN distance_km / 1.852e0 = 175 THEN 6 WHEN distance_km / 1.852e0 BETWEEN 0 AND 175 THEN CAST(floor(distance_km / 1.852e0 / 25) AS BIGINT) END AS band,
  CASE WHEN altitude_ft < 5000 THEN 0 WHEN altitude_ft < 10000 THEN 1 WHEN altitude_ft < 20000 THEN 2 WHEN altitude_ft < 30000 THEN 3 WHEN altitude_ft < 40000 THEN 4 ELSE 5 END AS lev
  FROM obs WHERE distance_km BETWEEN 0 AND 1000)
SELECT bucket, count(*) AS available, CAST(sum(captured) AS BIGINT) AS captured FROM (
  SELECT captured, unnest(['overall', 'az:' || az, 'range:' || band, 'alt:' || lev, 'polar:' || az || ':' || band]) AS bucket FROM r) WHERE bucket IS NOT NULL GROUP BY 1""", OBS)
def capture_grouping_sets(x: Frames) -> DataFrame:
    return receiver.capture_counters(x.observations())


@query("SELECT round(avg(CAST(origin = 'local' AS INT)) * 100, 6) AS ratio, count(*) AS positions FROM obs", OBS)
def capture_ratio_live(x: Frames) -> DataFrame:
    return x.observations().agg(F.round(F.avg((F.col("origin") == "local").cast("int")) * 100, 6).alias("ratio"), F.count("*").alias("positions"))


@query("""
, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY distance_km, event_id) - 1 AS i, count(*) OVER (PARTITION BY day) AS n FROM obs)
SELECT day, max(CASE WHEN i = floor((n - 1) * 0.5e0) THEN distance_km END) AS median_km, max(CASE WHEN i = floor((n - 1) * 0.9e0) THEN distance_km END) AS p90_km, round(max(distance_km) / 1.852e0, 1) AS max_nm FROM k GROUP BY day""", OBS)
def receiver_quality(x: Frames) -> DataFrame:
    return receiver.receiver_quality(x.observations())


@query("""
, w AS (SELECT *, sum(CASE WHEN epoch_us(observed_at) - p > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) AS session
  FROM (SELECT *, lag(epoch_us(observed_at)) OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) AS p FROM obs))
SELECT icao_hex, CAST(session AS BIGINT) AS session, count(*) AS positions, min(epoch_us(observed_at)) AS start_us, max(epoch_us(observed_at)) AS end_us, nullif(max(altitude_ft), 0) AS max_altitude, min(distance_km) AS min_distance_km FROM w GROUP BY 1, 2""", OBS)
def flight_sessions_gap(x: Frames) -> DataFrame:
    return sequences.gap_sessions(x.observations())


@query("SELECT icao_hex, event_id FROM obs WHERE observed_at <= TIMESTAMP '2024-01-15 12:00:00' AND observed_at >= TIMESTAMP '2024-01-15 10:00:00' QUALIFY row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at DESC, event_id DESC) = 1", OBS)
def asof_latest_per_station(x: Frames) -> DataFrame:
    return sequences.latest_before(x.observations("2024-01-15 10:00:00", "2024-01-15 12:00:01"), "2024-01-15 12:00:00")


@query("SELECT l.event_id, r.event_id AS asof_event_id FROM (SELECT * FROM obs WHERE origin = 'local') l ASOF LEFT JOIN (SELECT icao_hex, observed_at, max(event_id) AS event_id FROM obs WHERE origin = 'network' GROUP BY 1, 2) r ON l.icao_hex = r.icao_hex AND l.observed_at >= r.observed_at", OBS)
def asof_network_report(x: Frames) -> DataFrame:
    obs = x.observations().select("icao_hex", "observed_at", "event_id", "origin")
    right = obs.where("origin = 'network'").groupBy("icao_hex", "observed_at").agg(F.max("event_id").alias("event_id"))
    return sequences.asof_join(obs.where("origin = 'local'").drop("origin"), right, "icao_hex", "observed_at", ["event_id"]).select("event_id", "asof_event_id")


_LAST = "SELECT icao_hex, altitude_ft, lat, lon FROM obs WHERE {} QUALIFY row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at DESC, event_id DESC) = 1"


def _last(obs: DataFrame, condition: str) -> DataFrame:
    best = obs.where(condition).groupBy("icao_hex").agg(F.max(F.struct("observed_at", "event_id", "altitude_ft", "lat", "lon")).alias("b"))
    return best.select("icao_hex", "b.altitude_ft", "b.lat", "b.lon")


@query(f", a AS ({_LAST.format("day <= '2024-01-10'")}), b AS ({_LAST.format("day <= '2024-01-11' AND day >= '2024-01-05'")}) SELECT coalesce(a.icao_hex, b.icao_hex) AS icao_hex, CASE WHEN b.icao_hex IS NULL THEN 'removed' WHEN a.icao_hex IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.icao_hex = b.icao_hex WHERE a.icao_hex IS NULL OR b.icao_hex IS NULL OR (a.altitude_ft, a.lat, a.lon) IS DISTINCT FROM (b.altitude_ft, b.lat, b.lon)", OBS)
def snapshot_delta(x: Frames) -> DataFrame:
    obs = x.observations(until="2024-01-13")
    return sequences.snapshot_delta(_last(obs, "day <= '2024-01-10'"), _last(obs, "day <= '2024-01-11' AND day >= '2024-01-05'"), "icao_hex")


@query(f", a AS ({_LAST.format("origin = 'local'")}), b AS ({_LAST.format("origin = 'network'")}) SELECT coalesce(a.icao_hex, b.icao_hex) AS icao_hex, CASE WHEN a.icao_hex IS NULL THEN 'network' WHEN b.icao_hex IS NULL THEN 'local' ELSE 'overlap' END AS membership, coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon, coalesce(a.altitude_ft, b.altitude_ft) AS altitude_ft FROM a FULL JOIN b ON a.icao_hex = b.icao_hex", OBS)
def source_merge_full_outer(x: Frames) -> DataFrame:
    obs = x.observations()
    return sequences.merge_sources(_last(obs, "origin = 'local'"), _last(obs, "origin = 'network'"))


@query(f", a AS ({_LAST.format("origin = 'local'")}), b AS ({_LAST.format("origin = 'network'")}) SELECT coalesce(a.icao_hex, b.icao_hex) AS icao_hex, CASE WHEN a.icao_hex IS NULL THEN 'network' WHEN b.icao_hex IS NULL THEN 'local' ELSE 'overlap' END AS membership, CASE WHEN a.lat IS NOT NULL AND a.lon IS NOT NULL THEN a.lat ELSE b.lat END AS lat, CASE WHEN a.lat IS NOT NULL AND a.lon IS NOT NULL THEN a.lon ELSE b.lon END AS lon, coalesce(a.altitude_ft, b.altitude_ft) AS altitude_ft FROM a FULL JOIN b ON a.icao_hex = b.icao_hex", OBS)
def source_merge_all(x: Frames) -> DataFrame:
    """As ``source_merge_full_outer``, with the place checked as a whole."""
    obs = x.observations()
    return sequences.merge_sources(_last(obs, "origin = 'local'"), _last(obs, "origin = 'network'"))


@query("SELECT lanes, count(*) AS aircraft, CAST(max(bit_count(lanes)) AS BIGINT) AS n_lanes FROM (SELECT icao_hex, bit_or(1::BIGINT << CAST(event_id % 3 AS INT)) AS lanes FROM obs GROUP BY 1) GROUP BY 1", OBS)
def lane_value_bitmask(x: Frames) -> DataFrame:
    return sequences.lane_value(x.observations().withColumn("lane", F.col("event_id") % 3))


@query("SELECT bin, count(*) AS aircraft, CAST(sum(n) AS BIGINT) AS samples, round(avg(u), 6) AS east, round(avg(v), 6) AS north FROM (SELECT CAST(floor(altitude_ft / 2000) * 2000 AS BIGINT) AS bin, icao_hex, avg(-ground_speed * sin(radians(wind_from))) AS u, avg(-ground_speed * cos(radians(wind_from))) AS v, count(*) AS n FROM obs GROUP BY 1, 2) GROUP BY 1", OBS)
def weather_profile(x: Frames) -> DataFrame:
    return sequences.weather_profile(x.observations())


@query("SELECT CAST(floor(lat / 0.2e0) AS BIGINT) AS lat_cell, CAST(floor(lon / 0.2e0) AS BIGINT) AS lon_cell, CAST(CASE WHEN altitude_ft < 10000 THEN 0 WHEN altitude_ft < 20000 THEN 1 WHEN altitude_ft < 30000 THEN 2 WHEN altitude_ft < 40000 THEN 3 ELSE 4 END AS BIGINT) AS band, count(*) AS samples, count(DISTINCT icao_hex) AS aircraft, count(DISTINCT floor(epoch(observed_at) / 900)) AS buckets, median(nic) AS median_nic, round(count(*) FILTER (WHERE nic < 6) / CAST(count(*) AS DOUBLE), 6) AS low_share FROM obs GROUP BY 1, 2, 3", OBS)
def ni_baseline(x: Frames) -> DataFrame:
    return sequences.integrity_baseline(x.observations())


@query("""
, f AS (SELECT *, floor((epoch(start_time) - epoch(lag(last_seen_at) OVER (PARTITION BY aircraft_id ORDER BY start_time, flight_id))) / 86400) AS gap FROM fl),
d AS (SELECT aircraft_id, count(DISTINCT d) AS active_days FROM (SELECT aircraft_id, unnest(generate_series(CAST((start_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague' AS DATE), CAST((last_seen_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague' AS DATE), INTERVAL 1 DAY)) AS d FROM fl) GROUP BY 1)
SELECT aircraft_id, count(*) AS flights, CAST(max(gap) AS BIGINT) AS longest_gap_days, max(max_altitude) AS max_altitude, min(min_distance_km) AS min_distance_km, any_value(active_days) AS active_days FROM f JOIN d USING (aircraft_id) GROUP BY 1""", FLT)
def aircraft_history_summary(x: Frames) -> DataFrame:
    return traffic.history_summary(x.flights(), local_day)


@query("""
, f AS (SELECT *, count(*) OVER (PARTITION BY aircraft_id) AS n, row_number() OVER w AS r, CAST(floor((epoch(start_time) - epoch(lead(last_seen_at) OVER w)) / 86400) AS BIGINT) AS g FROM fl WINDOW w AS (PARTITION BY aircraft_id ORDER BY start_time DESC, flight_id DESC))
SELECT aircraft_id, flight_id, n AS flights, g AS gap_days, CASE WHEN n = 1 THEN 'new' WHEN g >= 30 THEN 'returning' WHEN n <= 3 THEN 'rare' ELSE 'regular' END AS label FROM f WHERE r = 1""", FLT)
def logbook_labels(x: Frames) -> DataFrame:
    return traffic.logbook_labels(x.flights())


@query("SELECT airport, count(*) FILTER (WHERE o = 0) AS arrivals, count(*) FILTER (WHERE o = 1) AS departures, count(DISTINCT flight_id) AS movements, count(DISTINCT aircraft_id) AS aircraft FROM (SELECT flight_id, aircraft_id, origin AS airport, 1 AS o FROM fl UNION ALL SELECT flight_id, aircraft_id, destination, 0 FROM fl) GROUP BY 1", FLT)
def airport_traffic(x: Frames) -> DataFrame:
    return traffic.airport_traffic(x.flights())


@query("""
, c AS (SELECT CAST(isodow(t) AS BIGINT) AS weekday, CAST(hour(t) AS BIGINT) AS hour, count(*) AS n FROM (SELECT (start_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague' AS t FROM fl WHERE origin = 'L003' OR destination = 'L003') GROUP BY 1, 2)
SELECT CAST(i // 24 + 1 AS BIGINT) AS weekday, CAST(i % 24 AS BIGINT) AS hour, coalesce(n, 0) AS movements FROM range(168) r(i) LEFT JOIN c ON c.weekday = i // 24 + 1 AND c.hour = i % 24""", FLT)
def airport_heatmap(x: Frames) -> DataFrame:
    return traffic.airport_heatmap(x.flights(), "L003", ZONE)


@query("SELECT CAST(hour((start_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague') AS BIGINT) AS hour, count(*) AS flights FROM fl GROUP BY 1", FLT)
def hour_of_day(x: Frames) -> DataFrame:
    return x.flights().groupBy(F.hour(F.from_utc_timestamp("start_time", ZONE)).cast("long").alias("hour")).agg(F.count("*").alias("flights"))


@query("SELECT flight_id, tier, field FROM (SELECT flight_id, CASE WHEN lower(callsign) = 'cs4' THEN 0 WHEN starts_with(lower(callsign), 'cs4') THEN 1 WHEN contains(lower(callsign), 'cs4') THEN 2 END AS tier, 0 AS field FROM fl) WHERE tier IS NOT NULL ORDER BY tier, field, flight_id LIMIT 20", FLT)
def flight_search_ranked(x: Frames) -> DataFrame:
    return traffic.search(x.flights(), "cs4")


@query("SELECT flight_id, aircraft_id, callsign FROM fl WHERE start_time >= TIMESTAMP '1995-01-01' AND start_time < TIMESTAMP '1996-01-01' AND (callsign ILIKE '%7%' OR origin ILIKE '%01%') ORDER BY start_time DESC, flight_id DESC LIMIT 100", FLT)
def flight_list_filtered(x: Frames) -> DataFrame:
    f = x.flights().where((F.col("start_time") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("start_time") < F.lit("1996-01-01").cast("timestamp")))
    return f.where(F.col("callsign").ilike("%7%") | F.col("origin").ilike("%01%")).orderBy(F.desc("start_time"), F.desc("flight_id")).limit(100).select("flight_id", "aircraft_id", "callsign")


@query("""
, d AS (SELECT icao, power(sin(radians(lat - 50e0) / 2), 2) + cos(radians(50e0)) * cos(radians(lat)) * power(sin(radians(lon - 15.5e0) / 2), 2) AS a FROM ap)
SELECT icao, round(2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS distance_km FROM d WHERE 2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a)) <= 150 ORDER BY distance_km, icao LIMIT 12""", FLT)
def nearby_airports(x: Frames) -> DataFrame:
    near = x.airports().where(geo.within_km(F.col("lat"), F.col("lon"), 50.0, 15.5, 150.0))
    return near.select("icao", F.round(geo.haversine_km(F.lit(50.0), F.lit(15.5), F.col("lat"), F.col("lon")), 6).alias("distance_km")).orderBy("distance_km", "icao").limit(12)


@query("SELECT q.code, coalesce(a.icao, b.icao) AS icao FROM (VALUES ('L003'), ('I07'), ('XX')) q(code) LEFT JOIN ap a ON a.icao = q.code LEFT JOIN ap b ON b.iata = q.code", FLT)
def airport_alias_resolve(x: Frames) -> DataFrame:
    asked = x.spark.createDataFrame([("L003",), ("I07",), ("XX",)], "code string")
    alias = x.airports().select(F.explode(F.array("icao", "iata")).alias("code"), "icao")
    return asked.join(alias, "code", "left")


_RING = [(49.2, 14.5), (49.2, 16.8), (50.4, 17.2), (50.8, 15.1), (50.1, 14.2)]
_INSIDE = " + ".join(f"CASE WHEN (({y1}e0 > lat) <> ({y2}e0 > lat)) AND lon < ({x2}e0 - {x1}e0) * (lat - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 THEN 1 ELSE 0 END" for (y1, x1), (y2, x2) in zip(_RING, _RING[1:] + _RING[:1], strict=True) if y1 != y2)


@query(f"SELECT icao_hex, count(*) AS positions FROM obs WHERE ({_INSIDE}) % 2 = 1 AND altitude_ft BETWEEN 5000 AND 24500 GROUP BY 1", OBS)
def point_in_sector(x: Frames) -> DataFrame:
    inside = geo.in_ring(F.col("lat"), F.col("lon"), _RING) & F.col("altitude_ft").between(5000, 24500)
    return x.observations().where(inside).groupBy("icao_hex").agg(F.count("*").alias("positions"))


@query("SELECT o_orderstatus AS status, count(*) AS deliveries, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def delivery_health(x: Frames) -> DataFrame:
    return sequences.delivery_health(x.table("orders"), "o_orderstatus", "o_orderdate", "o_orderkey")


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'obsolete' WHEN a.c_mktsegment IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'updated' END AS change FROM customer a FULL JOIN (SELECT CASE WHEN c_nationkey = 11 THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer) b ON a.c_custkey = b.c_custkey")
def import_diff(x: Frames) -> DataFrame:
    """Two versions of all customers: some have another segment in the second, those of one nation another key."""
    c = x.table("customer")
    key = F.when(F.col("c_nationkey") == 11, F.col("c_custkey") + 10_000_000).otherwise(F.col("c_custkey"))
    new = c.select(key.alias("c_custkey"), F.when(F.col("c_nationkey") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return sequences.import_diff(c, new, "c_custkey", "c_mktsegment")


@query("SELECT event_type, count(*) AS probes, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS worst FROM events GROUP BY 1")
def db_latency_window(x: Frames) -> DataFrame:
    return sequences.latency_window(x.table("events"))


@query("SELECT event_id, CASE WHEN sum(b) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN 'critical' WHEN sum(b) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN 'degraded' ELSE 'ok' END AS state FROM (SELECT *, CAST(value > 60 AS INT) AS b FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def runtime_incident_flags(x: Frames) -> DataFrame:
    return sequences.incident_flags(x.table("events"), 60.0)


@query("""
, k AS (SELECT icao_hex, event_id, row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) - 1 AS i, count(*) OVER (PARTITION BY icao_hex) AS n FROM obs)
SELECT icao_hex, event_id, i FROM k WHERE n <= 20 OR i IN (SELECT CAST(floor(j * (k.n - 1) / 19e0 + 0.5e0) AS BIGINT) FROM range(20) r(j))""", OBS)
def trail_downsample(x: Frames) -> DataFrame:
    return sequences.downsample(x.observations(), "icao_hex", 20)


@query(f"SELECT {_AZ} AS azimuth, origin, count(*) AS positions FROM obs GROUP BY 1, 2", OBS)
def source_stats(x: Frames) -> DataFrame:
    return x.observations().groupBy(azimuth(F.col("bearing")).alias("azimuth"), "origin").agg(F.count("*").alias("positions"))


@query("SELECT day, count(*) FILTER (greatest(event_id % 150 - 5, 0) <= 60) AS fresh, count(*) FILTER (greatest(event_id % 150 - 5, 0) > 60) AS stale, round(max(distance_km) / 1.852e0, 1) AS max_nm, CAST(list_extract(list_sort(list(greatest(event_id % 150 - 5, 0))), CAST(floor((count(*) - 1) * 0.5e0) AS INT) + 1) AS DOUBLE) AS median_age, CAST(list_extract(list_sort(list(greatest(event_id % 150 - 5, 0))), CAST(floor((count(*) - 1) * 0.9e0) AS INT) + 1) AS DOUBLE) AS p90_age, CASE WHEN count(*) FILTER (greatest(event_id % 150 - 5, 0) > 60) > count(*) FILTER (greatest(event_id % 150 - 5, 0) <= 60) THEN 'DEGRADED' ELSE 'GOOD' END AS state FROM obs GROUP BY day", OBS)
def position_quality(x: Frames) -> DataFrame:
    return receiver.position_quality(x.observations().withColumn("seen_pos", F.col("event_id") % 150 - 5), ["day"])


@query("SELECT CAST(floor(bearing / 10) * 10 AS BIGINT) AS azimuth, CAST(floor(distance_km / 25) * 25 AS BIGINT) AS km, CAST(floor(altitude_ft / 5000) * 5000 AS BIGINT) AS feet, count(*) AS positions FROM obs GROUP BY 1, 2, 3", OBS)
def coverage_buckets(x: Frames) -> DataFrame:
    return receiver.coverage_buckets(x.observations())


@query("SELECT day, icao_hex, last(t ORDER BY observed_at, event_id) FILTER (t IS NOT NULL) AS aircraft_type, count(*) AS positions FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN 'T' || event_id % 9 END AS t FROM obs) GROUP BY 1, 2", OBS)
def day_aircraft(x: Frames) -> DataFrame:
    return receiver.day_aircraft(x.observations().withColumn("aircraft_type", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("T"), F.col("event_id") % 9))), "aircraft_type")


@query(f"SELECT {_AZ} AS azimuth, max(distance_km) AS max_distance_km FROM obs WHERE distance_km BETWEEN 0 AND 1000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", OBS)
def best_sectors(x: Frames) -> DataFrame:
    return receiver.best_sectors(x.observations())


@query("SELECT o_orderkey AS occurrence_id, c_name AS rule, coalesce(n, 0) AS deliveries, coalesce(sent, 0) AS sent, statuses FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS sent, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS statuses FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def alert_occurrences(x: Frames) -> DataFrame:
    """Occurrences with the name of their rule and their deliveries."""
    per = x.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("deliveries"), F.count_if(F.col("l_linestatus") == "F").alias("sent"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"))
    named = x.table("orders").join(x.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("rule")), "o_custkey", "left")
    return named.join(per, "o_orderkey", "left").select(F.col("o_orderkey").alias("occurrence_id"), "rule", F.coalesce("deliveries", F.lit(0)).alias("deliveries"), F.coalesce("sent", F.lit(0)).alias("sent"), "statuses")


@query("SELECT icao, coalesce(runways, 0) AS runways, names, coalesce(frequencies, 0) AS frequencies FROM ap LEFT JOIN (SELECT 'L' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS icao, count(*) AS runways, array_to_string(list_sort(list(s_name)), ',') AS names FROM supplier GROUP BY 1) USING (icao) LEFT JOIN (SELECT 'L' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS icao, count(*) AS frequencies FROM customer GROUP BY 1) USING (icao)", FLT)
def airport_children(x: Frames) -> DataFrame:
    """Airports with what belongs to them, side by side."""
    code = lambda c: F.concat(F.lit("L"), F.lpad(F.col(c).cast("string"), 3, "0")).alias("icao")
    runways = x.table("supplier").groupBy(code("s_nationkey")).agg(F.count("*").alias("runways"), F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("names"))
    frequencies = x.table("customer").groupBy(code("c_nationkey")).agg(F.count("*").alias("frequencies"))
    return x.airports().join(runways, "icao", "left").join(frequencies, "icao", "left").select("icao", F.coalesce("runways", F.lit(0)).alias("runways"), "names", F.coalesce("frequencies", F.lit(0)).alias("frequencies"))


@query("SELECT origin AS sector, callsign, count(DISTINCT aircraft_id) AS aircraft, array_to_string(list_slice(list_sort(list(DISTINCT destination)), 1, 5), ',') AS labels, round(least(1, 0.4e0 + 0.1e0 * count(DISTINCT aircraft_id)), 6) AS confidence FROM (SELECT DISTINCT aircraft_id, origin, callsign, destination FROM fl) GROUP BY 1, 2", FLT)
def frequency_summary(x: Frames) -> DataFrame:
    """Each sector and call sign: aircraft, the first five labels, a confidence that grows with the aircraft."""
    once = x.flights().select("aircraft_id", "origin", "callsign", "destination").distinct()
    n = F.countDistinct("aircraft_id")
    return once.groupBy(F.col("origin").alias("sector"), "callsign").agg(n.alias("aircraft"), F.array_join(F.slice(F.array_sort(F.collect_set("destination")), 1, 5), ",").alias("labels"), F.round(F.least(F.lit(1.0), 0.4 + 0.1 * n), 6).alias("confidence"))


# The other families register themselves as well.
from . import chains, codes, feeds, folds, matching, records, reports, streams, summaries  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
