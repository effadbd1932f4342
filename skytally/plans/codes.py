"""Queries of codes and of rules on single records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, geo
from ..operators import integrity, records, reports, sequences
from ..sources.testdata import FLIGHTS, OBSERVATIONS, Frames
from .base import query
from .chains import STATES
from .matching import _hav
from .reports import NORM, texts

OBS = (OBSERVATIONS,)
_SIDE = "CASE event_id % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'c' WHEN 2 THEN '' ELSE 'X' END"
_RUNWAYS = f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'RWY ' WHEN 1 THEN ' runway' ELSE '' END || event_id * 7 % 41 || CASE event_id % 5 WHEN 0 THEN ' ' ELSE '' END || {_SIDE} AS raw FROM obs"


@query(f", t AS ({_RUNWAYS}) SELECT event_id, raw, CASE WHEN event_id * 7 % 41 BETWEEN 1 AND 36 AND event_id % 4 < 3 THEN lpad('' || event_id * 7 % 41, 2, '0') || upper({_SIDE}) END AS runway FROM t", OBS)
def runway_texts(x: Frames) -> DataFrame:
    return texts(x, _RUNWAYS).withColumn("runway", codes.runway(F.col("raw")))


_LETTERS = "chr(CAST(97 + event_id % 26 AS INT)) || chr(CAST(65 + event_id * 7 % 26 AS INT)) || chr(CAST(65 + event_id * 11 % 26 AS INT))"
_CODES = f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' L' || {_LETTERS} WHEN 1 THEN {_LETTERS} || ' ' WHEN 2 THEN 'LK' || {_LETTERS} ELSE {_LETTERS} || event_id % 10 END AS raw FROM obs"


@query(f", t AS ({_CODES}) SELECT event_id, raw, CASE WHEN event_id % 4 = 0 THEN 'L' || upper({_LETTERS}) END AS icao, CASE WHEN event_id % 4 = 1 THEN upper({_LETTERS}) END AS iata FROM t", OBS)
def airport_codes(x: Frames) -> DataFrame:
    return texts(x, _CODES).withColumns({"icao": codes.airport_code(F.col("raw"), 4), "iata": codes.airport_code(F.col("raw"), 3)})


_COVERS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'asp' WHEN 1 THEN 'GRSV' WHEN 2 THEN 'Conc' WHEN 3 THEN 'gre' WHEN 4 THEN 'turf' ELSE 'snow ' || event_id END AS raw FROM obs"


@query(f", t AS ({_COVERS}) SELECT event_id, raw, CASE event_id % 6 WHEN 0 THEN 'Asphalt' WHEN 1 THEN 'Grass' WHEN 2 THEN 'Concrete' WHEN 3 THEN 'Gravel' WHEN 4 THEN 'Turf' ELSE raw END AS surface FROM t", OBS)
def surface_labels(x: Frames) -> DataFrame:
    return texts(x, _COVERS).withColumn("surface", codes.surface_label(F.col("raw")))


_TYPES = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'B73' || event_id * 7 % 10 WHEN 1 THEN 'b77' || event_id * 7 % 10 WHEN 2 THEN 'E1' || event_id * 7 % 10 || '0' WHEN 3 THEN 'C' || event_id * 7 % 100 ELSE 'A3' || event_id * 7 % 100 END AS raw, CASE event_id % 11 WHEN 0 THEN 'A7' WHEN 1 THEN 'b1' WHEN 2 THEN 'C2' ELSE 'A3' END AS category FROM obs"
_N10, _N100 = "(event_id * 7 % 10)", "(event_id * 7 % 100)"


@query(f""", t AS ({_TYPES}) SELECT event_id, raw, CASE event_id % 11 WHEN 0 THEN 'helicopter' WHEN 1 THEN 'glider' WHEN 2 THEN 'ground' ELSE CASE event_id % 5
  WHEN 0 THEN CASE WHEN {_N10} IN (7, 8, 9) THEN 'b737' ELSE 'airplane' END WHEN 1 THEN CASE WHEN {_N10} IN (2, 3, 8, 9) THEN 'b777' ELSE 'airplane' END WHEN 2 THEN CASE WHEN {_N10} >= 3 THEN 'regional' ELSE 'airplane' END
  WHEN 3 THEN CASE WHEN {_N100} BETWEEN 50 AND 59 OR {_N100} BETWEEN 70 AND 79 OR {_N100} = 68 THEN 'business-jet' WHEN left('' || {_N100}, 1) <= '4' THEN 'general-aviation' ELSE 'airplane' END
  ELSE CASE WHEN {_N100} BETWEEN 18 AND 21 THEN 'a320' WHEN {_N100} IN (32, 33, 37, 38, 39) THEN 'a330' WHEN {_N100} = 59 THEN 'a350' WHEN {_N100} = 88 THEN 'a380' ELSE 'airplane' END END END AS family FROM t""", OBS)
def type_families(x: Frames) -> DataFrame:
    return texts(x, _TYPES).select("event_id", "raw", codes.type_family(F.col("raw"), F.col("category")).alias("family"))


@query("SELECT n_name, CASE n_nationkey % 5 WHEN 0 THEN 'heliport' WHEN 1 THEN 'significant' WHEN 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'significant' ELSE 'small' END WHEN 3 THEN 'small' ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'significant' WHEN n_nationkey % 3 = 0 THEN 'significant' ELSE 'small' END END AS tier FROM nation")
def airport_tiers(x: Frames) -> DataFrame:
    k = F.col("n_nationkey")
    kind = F.element_at(F.array(F.lit("Heliport"), F.lit("large_airport"), F.lit("small_airport"), F.lit("closed"), F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    return x.table("nation").select("n_name", codes.airport_tier(kind, k % 2 == 0, F.col("n_name"), F.when(k % 3 == 0, "ABC")).alias("tier"))


@query("""
, f AS (SELECT event_id, list_extract(['twr', 'ATIS', 'XYZ', 'GND', 'vor', 'NDB'], CAST(event_id % 6 + 1 AS INT)) AS kind, 108000 + event_id * 25 % 40000 AS khz FROM obs)
SELECT event_id, CASE upper(kind) WHEN 'TWR' THEN 3 WHEN 'ATIS' THEN 0 WHEN 'GND' THEN 2 ELSE 1000 END AS rank, CASE WHEN kind = 'vor' THEN printf('%.3f', khz / 1000e0) || ' MHz' ELSE khz || ' kHz' END AS shown, khz / 1000e0 BETWEEN 118 AND 136.975 AS control, CAST(floor(khz * 0.3048e0 + 0.5) AS BIGINT) AS metres FROM f""", OBS)
def frequency_formats(x: Frames) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("twr", "ATIS", "XYZ", "GND", "vor", "NDB"))), (F.col("event_id") % 6 + 1).cast("int"))
    khz = 108_000 + F.col("event_id") * 25 % 40_000
    return x.observations().select("event_id", codes.frequency_rank(kind).alias("rank"), codes.navaid_frequency(kind, khz).alias("shown"), codes.is_control_frequency(khz / 1000).alias("control"), codes.metres(khz).alias("metres"))


@query("""
SELECT event_id, 'v2:' || icao_hex || ':' || (epoch_us(observed_at) // 1000) || ':' || upper(origin) || ':' || CAST(floor(lat * 1000000 + 0.5) AS BIGINT) || ':' || CAST(floor(lon * 1000000 + 0.5) AS BIGINT) || ':' || CASE WHEN altitude_ft < 10000 THEN 0 ELSE 1 END AS key,
  'flight-route:' || lower(icao_hex) || ':CS' || event_id % 50 || ':' || day AS route_key, sha256('{"icao_hex":"' || icao_hex || '","day":"' || day || '"}') AS digest FROM obs""", OBS)
def identity_keys(x: Frames) -> DataFrame:
    band = F.when(F.col("altitude_ft") < 10_000, 0).otherwise(1)
    key = codes.observation_key(F.col("icao_hex"), F.col("observed_at"), F.upper("origin"), F.col("lat"), F.col("lon"), band)
    call = F.concat(F.lit(" cs"), F.col("event_id") % 50)
    return x.observations().select("event_id", key.alias("key"), codes.route_key(call, F.col("day"), F.col("icao_hex")).alias("route_key"), F.sha2(F.to_json(F.struct("icao_hex", "day")), 256).alias("digest"))


_BIT = lambda f, k: f"(({f} >> {k}) & 1)"
_DIGIT = lambda *ks: "CAST(" + " + ".join(f"{2**n} * {_BIT('f', k)}" for n, k in enumerate(ks)) + " AS VARCHAR)"


@query(f"""
, t AS (SELECT event_id, CAST(event_id * 2654435761 % 8192 AS BIGINT) AS f FROM obs)
SELECT event_id, {_DIGIT(11, 9, 7)} || {_DIGIT(5, 3, 1)} || {_DIGIT(12, 10, 8)} || {_DIGIT(4, 2, 0)} AS squawk, CASE WHEN {_BIT('f', 6)} = 0 AND {_BIT('f', 4)} = 1 THEN ((f // 128) * 32 + {_BIT('f', 5)} * 16 + f % 16) * 25 - 1000 END AS feet FROM t""", OBS)
def transponder_codes(x: Frames) -> DataFrame:
    f = (F.col("event_id") * 2_654_435_761 % 8192).cast("long")
    return x.observations().select("event_id", codes.squawk(f).alias("squawk"), codes.altitude_25ft(f).alias("feet"))


@query("SELECT aircraft_id, coalesce(CASE WHEN aircraft_id % 3 > 0 THEN 'OK-' || aircraft_id END, upper(registration)) AS registration FROM air", (FLIGHTS,))
def lasting_values(x: Frames) -> DataFrame:
    own = F.when(F.col("aircraft_id") % 3 > 0, F.concat(F.lit(" ok-"), F.col("aircraft_id"), F.lit(" "))).otherwise("  ")
    return x.aircraft().select("aircraft_id", codes.lasting_text(own, F.col("registration"), upper=True).alias("registration"))


@query("""
, l AS (SELECT icao_hex, count(*) AS n, min(observed_at) AS f, max(CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END) AS alarm, arg_max(distance_km, (observed_at, event_id)) AS km FROM obs GROUP BY 1)
SELECT icao_hex, CASE WHEN f >= TIMESTAMP '2024-01-01 03:00:00' THEN 10 ELSE 0 END + alarm * 9 + CASE WHEN n <= 60 THEN 1 ELSE 0 END AS score, n AS positions FROM l WHERE f >= TIMESTAMP '2024-01-01 03:00:00' OR alarm = 1 OR n <= 60 ORDER BY score DESC, n DESC, icao_hex LIMIT 8""", OBS)
def interesting_aircraft(x: Frames) -> DataFrame:
    """New ones, those with an alarm and rare ones, by a score."""
    per = x.observations().groupBy("icao_hex").agg(F.count("*").alias("positions"), F.min("observed_at").alias("first"), F.max(F.col("event_id") % 40 == 0).alias("alarm"))
    new, rare = F.col("first") >= F.lit("2024-01-01 03:00:00").cast("timestamp"), F.col("positions") <= 60
    scored = per.withColumn("score", F.when(new, 10).otherwise(0) + F.when(F.col("alarm"), 9).otherwise(0) + F.when(rare, 1).otherwise(0)).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("positions"), "icao_hex").limit(8).select("icao_hex", "score", "positions")


@query("SELECT kind, id, tier, field FROM (SELECT 'flight' AS kind, CAST(flight_id AS VARCHAR) AS id, CASE WHEN lower(callsign) = 'cs1' THEN 0 WHEN lower(callsign) LIKE 'cs1%' THEN 1 END AS tier, 0 AS field FROM fl UNION ALL SELECT 'airport', icao, CASE WHEN lower(icao) = 'cs1' THEN 0 WHEN lower(name) LIKE '%cs1%' THEN 2 END, 1 FROM ap UNION ALL SELECT 'aircraft', icao_hex, CASE WHEN lower(operator) LIKE '%cs1%' THEN 2 END, 2 FROM air) WHERE tier IS NOT NULL ORDER BY tier, kind, field, id LIMIT 20", (FLIGHTS,))
def search_all(x: Frames) -> DataFrame:
    """One term over flights, airports and aircraft: exact before beginnings before parts."""
    q = "cs1"

    def part(df: DataFrame, kind: str, ident: str, field: str, at: int) -> DataFrame:
        low = F.lower(field)
        tier = F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2)
        return df.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), tier.alias("tier"), F.lit(at).alias("field")).where("tier IS NOT NULL")

    flights = part(x.flights(), "flight", "flight_id", "callsign", 0)
    hits = flights.unionByName(part(x.airports(), "airport", "icao", "name", 1)).unionByName(part(x.aircraft(), "aircraft", "icao_hex", "operator", 2))
    return hits.orderBy("tier", "kind", "field", "id").limit(20)


@query("SELECT icao_hex, event_id, distance_km FROM (SELECT *, CASE WHEN event_id % 6 > 0 THEN distance_km END AS d FROM obs WHERE day = '2024-01-10') t(event_id, icao_hex, observed_at, lat, lon, altitude_ft, ground_speed, event_type, origin, raw_messages, nic, nac_p, wind_from, day, km, bearing, distance_km) ORDER BY distance_km ASC NULLS LAST, icao_hex, event_id LIMIT 40", OBS)
def aircraft_by_distance(x: Frames) -> DataFrame:
    d = x.observations().where("day = '2024-01-10'").withColumn("distance_km", F.when(F.col("event_id") % 6 > 0, F.col("distance_km")))
    return d.orderBy(F.asc_nulls_last("distance_km"), "icao_hex", "event_id").limit(40).select("icao_hex", "event_id", "distance_km")


@query(f"SELECT event_id, icao_hex FROM obs WHERE observed_at >= TIMESTAMP '2024-01-15 10:00:00' AND observed_at < TIMESTAMP '2024-01-15 22:00:00' AND altitude_ft BETWEEN 3000 AND 39000 AND origin = 'network' AND {_hav('50e0', '15.5e0', 'lat', 'lon')} <= 80", OBS)
def weather_query(x: Frames) -> DataFrame:
    """By time, altitude, source, and radius with a box before the exact distance."""
    o = x.observations("2024-01-15 10:00:00", "2024-01-15 22:00:00").where(F.col("altitude_ft").between(3000, 39_000) & (F.col("origin") == "network"))
    return o.where(geo.within_km(F.col("lat"), F.col("lon"), 50.0, 15.5, 80.0)).select("event_id", "icao_hex")


@query("SELECT user_id, CASE WHEN o THEN 'OFFLINE' WHEN r < 1 OR pa > 60 OR n = 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state, CASE WHEN o THEN 'CHECK_READSB' WHEN r < 1 OR n = 0 THEN 'CHECK_ANTENNA_OR_RF' WHEN pa > 60 THEN 'OBSERVE' ELSE 'NONE' END AS action FROM (SELECT user_id, count(*) % 7 = 0 AS o, count(*) % 5 / 2e0 AS r, count(*) % 90 AS pa, count(*) % 11 AS n FROM events GROUP BY 1)")
def receiver_monitoring(x: Frames) -> DataFrame:
    n = F.count("*")
    per = x.table("events").groupBy("user_id").agg((n % 7 == 0).alias("offline"), (n % 5 / 2.0).alias("rate"), (n % 90).alias("position_age"), (n % 11).alias("aircraft"))
    return records.monitoring(per).select("user_id", "state", "action")


_RUNS = "QUALIFY row_number() OVER (PARTITION BY icao_hex, lane ORDER BY last_seen_us DESC, event_id DESC) = 1"


@query(f"""
, r AS (SELECT *, event_id % 3 AS lane FROM norm {_RUNS})
SELECT icao_hex, last(callsign ORDER BY last_seen_us, lane) FILTER (callsign IS NOT NULL) AS callsign, last(squawk ORDER BY last_seen_us, lane) FILTER (squawk IS NOT NULL) AS squawk, max(last_seen_us) AS last_seen_us, array_to_string(list_sort(list(DISTINCT CAST(lane AS VARCHAR))), ',') AS lanes,
  {', '.join(f"last({c} ORDER BY coalesce(position_us, -1), last_seen_us, lane) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS {c}" for c in ('lat', 'lon', 'altitude_ft', 'ground_speed', 'source'))} FROM r GROUP BY 1""", NORM)
def lane_merge(x: Frames) -> DataFrame:
    n = reports.normalised(x.raw()).withColumn("lane", F.col("event_id") % 3)
    rank = F.row_number().over(Window.partitionBy("icao_hex", "lane").orderBy(F.desc("last_seen_us"), F.desc("event_id")))
    return reports.merge_lanes(n.withColumn("rank", rank).where("rank = 1"))


@query(f"""
, r AS (SELECT *, event_id % 2 AS lane FROM norm {_RUNS}),
j AS (SELECT f, s, coalesce(f.last_seen_us >= s.last_seen_us, true) AS newer FROM (SELECT * FROM r WHERE lane = 0) f FULL JOIN (SELECT * FROM r WHERE lane = 1) s ON f.icao_hex = s.icao_hex),
k AS (SELECT *, f.lat IS NULL OR (s.lat IS NOT NULL AND coalesce(s.seen_pos <= 30, false) AND {_hav('f.lat', 'f.lon', 's.lat', 's.lon')} > 25) AS sf FROM j)
SELECT coalesce(f.icao_hex, s.icao_hex) AS icao_hex, {', '.join(f"CASE WHEN f.{c} IS NULL THEN s.{c} WHEN s.{c} IS NULL OR newer THEN f.{c} ELSE s.{c} END AS {c}" for c in ('callsign', 'squawk', 'ground_speed'))},
  CASE WHEN abs(f.altitude_ft - s.altitude_ft) > 12000 OR f.altitude_ft IS NULL THEN s.altitude_ft WHEN s.altitude_ft IS NULL OR newer THEN f.altitude_ft ELSE s.altitude_ft END AS altitude_ft, CASE WHEN sf THEN CASE WHEN s.lat IS NOT NULL THEN s.lat END ELSE f.lat END AS lat, CASE WHEN sf THEN CASE WHEN s.lat IS NOT NULL THEN s.lon END ELSE f.lon END AS lon FROM k""", NORM)
def receiver_merge(x: Frames) -> DataFrame:
    n = reports.normalised(x.raw())
    frames, summary = (reports.newest(n.where(F.col("event_id") % 2 == k)) for k in (0, 1))
    return reports.merge_receiver(frames, summary)


@query("""
WITH b AS (SELECT *, CAST(value > 60 AS INT) AS b FROM events), r AS (SELECT *, CASE WHEN sum(b) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN 3 WHEN sum(b) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN 2 ELSE b END AS rank FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN rank > 0 AND coalesce(lag(rank) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st, lead(event_id) OVER w AS nx FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS incident FROM s)
SELECT user_id, CAST(incident AS BIGINT) AS incident, count(*) AS occurrences, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id, last(nx ORDER BY ts, event_id) AS resolved_id, list_extract(['warning', 'degraded', 'critical'], max(rank)) AS severity FROM i WHERE rank > 0 GROUP BY 1, 2""")
def runtime_incidents(x: Frames) -> DataFrame:
    return sequences.incidents(x.table("events"), 60.0)
