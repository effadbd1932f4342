"""Queries of stored records: joins, filters, quality rules, snapshots and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import weather_band
from ..operators import records, reports
from ..sources.testdata import FLIGHTS, OBSERVATIONS, RECEIVER, Frames
from .base import query
from .matching import _brg, _hav, _turn
from .reports import NORM

OBS, FLT = (OBSERVATIONS,), (FLIGHTS,)


@query("SELECT flight_id, icao_hex, coalesce(CASE WHEN flight_id % 3 = 0 THEN 'OWN' || flight_id % 9 END, registration) AS registration, operator FROM fl JOIN air USING (aircraft_id)", FLT)
def flight_with_aircraft(x: Frames) -> DataFrame:
    own = x.flights().withColumns({"registration": F.when(F.col("flight_id") % 3 == 0, F.concat(F.lit("OWN"), F.col("flight_id") % 9)), "operator": F.lit(None).cast("string")})
    return records.with_aircraft(own, x.aircraft()).select("flight_id", "icao_hex", "registration", "operator")


@query("SELECT flight_id, callsign FROM fl WHERE callsign ILIKE '%build%' OR aircraft_type ILIKE '%build%' OR airline ILIKE '%build%' OR origin ILIKE '%build%' OR destination ILIKE '%build%' OR aircraft_id IN (SELECT aircraft_id FROM air WHERE registration ILIKE '%build%' OR operator ILIKE '%build%') ORDER BY start_time DESC, flight_id DESC LIMIT 100", FLT)
def flight_list_search(x: Frames) -> DataFrame:
    return records.find_flights(x.flights(), x.aircraft(), "build").select("flight_id", "callsign")


@query("SELECT flight_id FROM fl WHERE aircraft_id IN (SELECT aircraft_id FROM air WHERE operator ILIKE 'mach%')", FLT)
def flight_semi_aircraft(x: Frames) -> DataFrame:
    return x.flights().join(x.aircraft().where(F.col("operator").ilike("mach%")), "aircraft_id", "left_semi").select("flight_id")


@query("""
, k AS (SELECT icao_hex, arg_max(n, (n.last_seen_us, n.event_id)) AS r, max(CASE WHEN origin = 'local' THEN 1 ELSE 0 END) AS l, max(CASE WHEN origin = 'network' THEN 1 ELSE 0 END) AS w FROM norm n GROUP BY 1)
SELECT icao_hex, CASE WHEN l = 1 AND w = 1 THEN 'overlap' WHEN l = 1 THEN 'local' ELSE 'network' END AS membership, r.altitude_ft AS altitude_ft FROM k WHERE l = 1 AND NOT r.on_ground AND r.altitude_ft BETWEEN 5000 AND 36000""", NORM)
def map_filters(x: Frames) -> DataFrame:
    n = reports.normalised(x.raw())
    kinds = n.groupBy("icao_hex").agg(F.max(F.col("origin") == "local").alias("l"), F.max(F.col("origin") == "network").alias("w"))
    both = reports.newest(n.select("icao_hex", "last_seen_us", "event_id", "altitude_ft", "on_ground", "emergency", "callsign")).join(kinds, "icao_hex")
    named = both.withColumn("membership", F.when(F.col("l") & F.col("w"), "overlap").when(F.col("l"), "local").otherwise("network"))
    return records.map_filter(named, source="local", status="airborne", low=5000, high=36000).select("icao_hex", "membership", "altitude_ft")


_RULES = [(1, "icao_hex", " 00000a ", None), (2, "callsign", "cs7", 60.0), (3, "callsignPattern", "CS1*", None), (4, "callsignPattern", "CS[1]", None), (5, "event_type", "click", 20.0)]


@query("""
, c AS (SELECT *, lower('CS' || CAST(event_id % 50 AS VARCHAR)) AS cs FROM obs)
SELECT event_id, 1 AS rule_id FROM c WHERE lower(icao_hex) = '00000a' UNION ALL SELECT event_id, 2 FROM c WHERE cs = 'cs7' AND distance_km <= 60 UNION ALL SELECT event_id, 3 FROM c WHERE cs LIKE 'cs1%' UNION ALL SELECT event_id, 5 FROM c WHERE event_type = 'click' AND distance_km <= 20""", OBS)
def watch_rules(x: Frames) -> DataFrame:
    return records.matched_rules(x.observations().withColumn("callsign", F.concat(F.lit("CS"), F.col("event_id") % 50)), _RULES)


_WEATHER = "SELECT event_id, icao_hex, observed_at, altitude_ft, CASE WHEN event_id % 4 > 0 THEN (event_id * 29) % 190 - 110 END AS temperature_c, CASE WHEN event_id % 3 > 0 THEN (event_id * 71) % 530 END AS wind_kt, wind_from FROM obs"


def _weather(x: Frames) -> DataFrame:
    return x.made(_WEATHER, obs=x.observations())


@query(f"""
, w AS ({_WEATHER}), p AS (SELECT *, lag(event_id) OVER o AS pe, epoch_ms(observed_at) - epoch_ms(lag(observed_at) OVER o) AS el, lag(temperature_c) OVER o AS pt, lag(wind_kt) OVER o AS pw, lag(wind_from) OVER o AS pd FROM w WINDOW o AS (PARTITION BY icao_hex ORDER BY observed_at, event_id)),
r AS (SELECT *, CASE WHEN altitude_ft NOT BETWEEN 0 AND 60000 THEN 'ALTITUDE_RANGE' WHEN temperature_c NOT BETWEEN -100 AND 70 THEN 'TEMPERATURE_RANGE' WHEN wind_kt NOT BETWEEN 0 AND 512 THEN 'WIND_SPEED_RANGE' WHEN el > 0 AND el <= 15000 AND abs(temperature_c - pt) > 50 THEN 'TEMPERATURE_JUMP' WHEN el > 0 AND el <= 15000 AND abs({_turn('wind_from', 'pd')}) > 150 AND abs(wind_kt - pw) > 200 THEN 'WIND_SPIKE' END AS reason FROM p)
SELECT event_id, CASE WHEN reason IS NOT NULL THEN 'REJECTED' WHEN pe IS NULL THEN 'HIGH' ELSE 'GOOD' END AS quality, reason FROM r""", OBS)
def weather_qc(x: Frames) -> DataFrame:
    return records.weather_quality(_weather(x))


@query(f"""
, w AS ({_WEATHER}), h AS (SELECT *, epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(observed_at) AS age, CASE WHEN altitude_ft < 10000 THEN 'below_FL100' WHEN altitude_ft < 20000 THEN 'FL100_FL200' WHEN altitude_ft < 30000 THEN 'FL200_FL300' WHEN altitude_ft < 40000 THEN 'FL300_FL400' ELSE 'above_FL400' END AS band FROM w)
SELECT win, band, count(*) AS samples, count(temperature_c) AS with_temperature, count(wind_kt) AS with_wind, count(DISTINCT icao_hex) AS aircraft FROM h, (VALUES ('1h', 3600), ('24h', 86400), ('7d', 604800)) v(win, s) WHERE age >= 0 AND age < s GROUP BY 1, 2""", OBS)
def weather_quality(x: Frames) -> DataFrame:
    at = F.lit("2024-01-20").cast("timestamp")
    w = _weather(x).where((F.col("observed_at") <= at) & (F.col("observed_at") > at - F.expr("INTERVAL 7 DAYS")))
    age = F.unix_micros(at) - F.unix_micros("observed_at")
    windows = F.array_compact(F.array(*(F.when(age < s * 1_000_000, F.lit(n)) for n, s in (("1h", 3600), ("24h", 86_400), ("7d", 604_800)))))
    band = weather_band(F.col("altitude_ft"))
    return w.select("*", F.explode(windows).alias("win")).groupBy("win", band.alias("band")).agg(F.count("*").alias("samples"), F.count("temperature_c").alias("with_temperature"), F.count("wind_kt").alias("with_wind"), F.countDistinct("icao_hex").alias("aircraft"))


@query("""
, r AS (SELECT icao_hex, observed_at, arg_max(altitude_ft // 20000 * 100, event_id) AS altitude_ft FROM obs GROUP BY 1, 2), k AS (SELECT *, max(epoch_us(observed_at)) OVER (PARTITION BY icao_hex) AS e FROM r QUALIFY epoch_us(observed_at) >= e - CAST(720 AS BIGINT) * 60000000)
SELECT icao_hex, arg_max(altitude_ft, observed_at) AS altitude_ft, count(*) AS samples FROM k GROUP BY 1 HAVING count(*) >= 3 AND max(epoch_us(observed_at)) - min(epoch_us(observed_at)) >= 120000000 AND max(altitude_ft) - min(altitude_ft) <= 150""", OBS)
def stable_altitude(x: Frames) -> DataFrame:
    """Altitudes in two steps, over half a day, as the test reports are far apart."""
    return records.stable_altitude(x.observations().withColumn("altitude_ft", F.floor(F.col("altitude_ft") / 20_000) * 100), minutes=720)


@query("""
, g AS (SELECT *, CAST(floor((epoch(start_time) - epoch(lag(last_seen_at) OVER (PARTITION BY aircraft_id ORDER BY start_time, flight_id))) / 86400) AS BIGINT) AS gap FROM fl)
SELECT aircraft_id, count(*) AS flights, CAST(epoch(min(start_time)) AS BIGINT) AS first_s, CAST(epoch(max(last_seen_at)) AS BIGINT) AS last_s, max(max_altitude) AS max_altitude, count(DISTINCT callsign) AS callsigns, last(gap ORDER BY start_time, flight_id) AS returning_days, last(callsign ORDER BY start_time, flight_id) AS last_callsign FROM g GROUP BY 1""", FLT)
def lifetime_stats(x: Frames) -> DataFrame:
    return records.lifetime(x.flights())


@query("SELECT o_orderstatus AS status, count(*) AS deliveries, round(sum(o_totalprice), 2) AS amount, max(o_orderdate) AS newest, arg_max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END, (o_orderdate, o_orderkey)) AS latest_error FROM orders GROUP BY 1")
def delivery_report(x: Frames) -> DataFrame:
    return records.by_status(x.table("orders"), "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderkey", "F")


_QUEUE = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'CLAIMED' WHEN 3 THEN 'SENT' ELSE 'FAILED' END AS state, event_id % 11 AS attempts, event_id % 700 AS age_s FROM obs"


@query(f"""
, q AS ({_QUEUE}), d AS (SELECT *, state IN ('PENDING', 'RETRY') AND age_s >= CASE WHEN attempts = 0 THEN 0 ELSE least(900, power(2, attempts)) END AS due FROM q)
SELECT event_id, CASE WHEN state = 'CLAIMED' AND age_s > 300 THEN CASE WHEN attempts >= 8 THEN 'FAILED' ELSE 'RETRY' END WHEN due AND attempts >= 8 THEN 'FAILED' WHEN due THEN 'CLAIMED' ELSE state END AS next FROM d""", OBS)
def delivery_poll(x: Frames) -> DataFrame:
    return records.next_delivery_state(x.made(_QUEUE, obs=x.observations())).select("event_id", "next")


_ROUTE = "SELECT flight_id, CASE flight_id % 4 WHEN 0 THEN 'dct ' || origin || '  L' || flight_id % 999 || ' VOZ' WHEN 1 THEN 'ABC DCT ' || destination WHEN 2 THEN 'M' || flight_id % 99 || 'A x1y2 OKG' ELSE '12345' END AS route FROM fl"
_TOKENS = f"""tok AS (SELECT flight_id, i - 1 AS place, ws[i] AS token FROM (SELECT flight_id, regexp_extract_all(route, '\\S+') AS ws FROM ({_ROUTE})), range(1, 9) r(i) WHERE i <= len(ws)),
kinds AS (SELECT *, CASE WHEN upper(token) = 'DCT' THEN 'DIRECT' WHEN regexp_full_match(upper(token), '[A-Z][0-9]{{1,3}}[A-Z]?') THEN 'AIRWAY' WHEN upper(token) IN ('X1Y2') OR regexp_full_match(upper(token), '[A-Z]{{2,5}}') THEN 'WAYPOINT' ELSE 'UNKNOWN' END AS kind FROM tok)"""


def _tokens(x: Frames) -> DataFrame:
    return records.route_tokens(x.made(_ROUTE, fl=x.flights()), ["X1Y2"])


@query(f", {_TOKENS} SELECT * FROM kinds", FLT)
def route_tokens(x: Frames) -> DataFrame:
    return _tokens(x)


@query(f", {_TOKENS} SELECT flight_id, round(count(*) FILTER (kind <> 'UNKNOWN') * 100e0 / count(*), 1) AS percent, round(avg(CASE WHEN kind = 'AIRWAY' THEN 1e0 WHEN kind <> 'UNKNOWN' THEN 0.72e0 END), 6) AS confidence, CASE WHEN count(*) FILTER (kind = 'UNKNOWN') = 0 THEN 'RESOLVED' WHEN count(*) FILTER (kind <> 'UNKNOWN') > 0 THEN 'PARTIAL' ELSE 'UNRESOLVED' END AS status FROM kinds GROUP BY 1", FLT)
def route_status(x: Frames) -> DataFrame:
    return records.route_status(_tokens(x))


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(value, epoch(ts)), 6) END AS r, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def runtime_metrics(x: Frames) -> DataFrame:
    e = x.table("events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.corr("value", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), 6)).alias("r"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


_SNAP = "SELECT icao_hex, event_id FROM obs WHERE day = '{}' QUALIFY row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at DESC, event_id DESC) = 1"


def _snap(x: Frames, day: str) -> DataFrame:
    return x.observations().where(F.col("day") == day).groupBy("icao_hex").agg(F.max_by("event_id", F.struct("observed_at", "event_id")).alias("event_id"))


@query(f", a AS ({_SNAP.format('2024-01-10')}), b AS ({_SNAP.format('2024-01-11')}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE icao_hex NOT IN (SELECT icao_hex FROM b) AND icao_hex NOT LIKE '%1'", OBS)
def apply_delta(x: Frames) -> DataFrame:
    before, changed = _snap(x, "2024-01-10"), _snap(x, "2024-01-11")
    removed = before.where("icao_hex LIKE '%1'").join(changed, "icao_hex", "left_anti").select("icao_hex")
    return records.apply_delta(before, changed, removed, "icao_hex", 7, 7)


@query(f", a AS ({_SNAP.format('2024-01-10')}), b AS ({_SNAP.format('2024-01-11')}) SELECT icao_hex, 'missing' AS change FROM a WHERE icao_hex NOT IN (SELECT icao_hex FROM b) UNION ALL SELECT icao_hex, 'recovered' FROM b WHERE icao_hex NOT IN (SELECT icao_hex FROM a)", OBS)
def membership_changes(x: Frames) -> DataFrame:
    return records.membership_changes(_snap(x, "2024-01-10"), _snap(x, "2024-01-11"), "icao_hex")


@query(f", a AS ({_SNAP.format('2024-01-10')}), b AS ({_SNAP.format('2024-01-11')}), c AS ({_SNAP.format('2024-01-12')}) SELECT * FROM c UNION ALL SELECT * FROM b WHERE icao_hex NOT IN (SELECT icao_hex FROM c) UNION ALL SELECT * FROM a WHERE icao_hex NOT IN (SELECT icao_hex FROM c) AND icao_hex NOT IN (SELECT icao_hex FROM b)", OBS)
def dataset_merge(x: Frames) -> DataFrame:
    return records.last_of([_snap(x, f"2024-01-{d}") for d in (10, 11, 12)], "icao_hex", ["event_id"])


@query("SELECT coalesce(a.c_custkey, b.k) AS c_custkey, coalesce(b.seg, a.c_mktsegment) AS c_mktsegment, a.c_custkey IS NULL OR (b.seg IS NOT NULL AND b.seg <> a.c_mktsegment) AS written FROM customer a FULL JOIN (SELECT CASE WHEN c_nationkey <= 5 THEN c_custkey + 10000000 ELSE c_custkey END AS k, CASE WHEN c_nationkey > 12 THEN 'NEW' END AS seg FROM customer) b ON k = c_custkey")
def upsert_changed(x: Frames) -> DataFrame:
    """All customers as stored; all as delivered, some under new keys, some with another segment, the rest without one."""
    c = x.table("customer")
    key = F.when(F.col("c_nationkey") <= 5, F.col("c_custkey") + 10_000_000).otherwise(F.col("c_custkey"))
    new = c.select(key.alias("c_custkey"), F.when(F.col("c_nationkey") > 12, "NEW").alias("c_mktsegment"))
    return records.upsert_changed(c, new, "c_custkey", ["c_mktsegment"])


@query("SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 04:00:00') GROUP BY 1")
def insert_ignore(x: Frames) -> DataFrame:
    e = x.table("events").select("user_id", "ts", "event_id")
    return records.insert_new(e.where(F.col("ts") < F.lit("2024-01-01 04:00:00").cast("timestamp")), e, "user_id", ["ts", "event_id"])


@query("SELECT count(*) AS kept, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 7 DAY")
def retention(x: Frames) -> DataFrame:
    return records.retained(x.table("events"), "ts", "2024-01-31 12:00:00", 7).agg(F.count("*").alias("kept"), F.min("event_id").alias("first_id"))


@query('''SELECT c_custkey || ',' || '"x, ' || c_name || ' ""' || c_mktsegment || '""",' || CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS line FROM customer''')
def csv_export(x: Frames) -> DataFrame:
    c = x.table("customer").select("c_custkey", F.concat(F.lit("x, "), "c_name", F.lit(' "'), "c_mktsegment", F.lit('"')).alias("note"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("nation"))
    return records.csv_lines(c, ["c_custkey", "note", "nation"])


@query(f"SELECT 'approximate' AS mode, event_id, icao_hex, lat, lon, altitude_ft, round({_hav('50e0', '15.4e0', 'lat', 'lon')}, 5) AS distance_km, round({_brg('50e0', '15.4e0', 'lat', 'lon')}, 5) AS bearing FROM obs UNION ALL SELECT 'hidden', event_id, icao_hex, lat, lon, altitude_ft, NULL, NULL FROM obs", OBS)
def public_projection(x: Frames) -> DataFrame:
    part = lambda mode: records.public_view(x.observations(), mode, RECEIVER[0] + 0.03, 15.43).withColumn("mode", F.lit(mode))
    return part("approximate").unionByName(part("hidden"))
