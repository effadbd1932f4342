"""Queries of geometry and of spatial, as-of and interval matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import matching
from ..sources.testdata import FLIGHTS, OBSERVATIONS, SECTORS, SEGMENTS, Frames
from .base import query

SEC, SEG = f"sectors AS ({SECTORS})", f"segments AS ({SEGMENTS})"


def _hav(a: str, b: str, c: str, d: str) -> str:
    x = f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371e0 * atan2(sqrt({x}), sqrt(1 - {x})))"


def _brg(a: str, b: str, c: str, d: str) -> str:
    t = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"(CASE WHEN {t} < 0 THEN {t} + 360 ELSE {t} END)"


def _turn(a: str, b: str) -> str:
    """From a to b, both of them in 0..540."""
    return f"(fmod({b} - {a} + 900e0, 360e0) - 180)"


def _segment(s: str = "") -> str:
    """Columns near, far, whole, along, across of obs against the segment beside it, in SQL."""
    near, whole, far = _hav("lat1", "lon1", "lat", "lon"), _hav("lat1", "lon1", "lat2", "lon2"), _hav("lat2", "lon2", "lat", "lon")
    apart = f"radians({_brg('lat1', 'lon1', 'lat', 'lon')} - {_brg('lat1', 'lon1', 'lat2', 'lon2')})"
    return f"{near} AS near, {whole} AS whole, {far} AS far, atan2(sin({near} / 6371e0) * cos({apart}), cos({near} / 6371e0)) * 6371e0 AS along, asin(sin({near} / 6371e0) * sin({apart})) * 6371e0 AS across"


_PAIRED = f"""
pair AS (SELECT event_id, obs.lat, obs.lon, wind_from AS track, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM obs JOIN ap a ON a.icao = 'L' || lpad(CAST(event_id % 25 AS VARCHAR), 3, '0') JOIN ap b ON b.icao = 'L' || lpad(CAST(event_id * 7 % 25 AS VARCHAR), 3, '0')),
seg AS (SELECT *, {_segment()} FROM pair)"""


def _paired(x: Frames) -> DataFrame:
    """Each observation with an origin and a destination."""
    code = lambda k: F.concat(F.lit("L"), F.lpad(k.cast("string"), 3, "0"))
    o = x.observations().select("event_id", "lat", "lon", F.col("wind_from").alias("track"), code(F.col("event_id") % 25).alias("a"), code(F.col("event_id") * 7 % 25).alias("b"))
    ends = lambda n: x.airports().select(F.col("icao").alias("ab"[n - 1]), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    return o.join(ends(1), "a").join(ends(2), "b")



def _six() -> list:
    return [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2", "lat", "lon")]


@query(f", {_PAIRED} SELECT event_id, round(CASE WHEN whole = 0 OR along <= 0 THEN near WHEN along >= whole THEN far ELSE abs(across) END, 5) AS km, CASE WHEN whole = 0 OR along <= 0 THEN near WHEN along >= whole THEN far ELSE abs(across) END <= 100 AS plausible FROM seg", (OBSERVATIONS, FLIGHTS))
def route_plausibility(x: Frames) -> DataFrame:
    km = geo.segment_km(*_six())
    return _paired(x).select("event_id", F.round(km, 5).alias("km"), (km <= 100).alias("plausible"))


@query(f", {_PAIRED} SELECT event_id, round(along, 5) AS along_km, round(across, 5) AS across_km, round(greatest(0, abs({_turn(_brg('lat1', 'lon1', 'lat2', 'lon2'), 'track')}) - 75), 5) AS penalty FROM seg WHERE whole > 0", (OBSERVATIONS, FLIGHTS))
def cross_track(x: Frames) -> DataFrame:
    """Along and across a leg, and how far the track is beyond 75 degrees of its course."""
    p = _six()
    along, across = geo.along_across_km(*p)
    off = F.abs(geo.turn(geo.bearing(*p[:4]), F.col("track")))
    return _paired(x).where((F.col("lat1") != F.col("lat2")) | (F.col("lon1") != F.col("lon2"))).select("event_id", F.round(along, 5).alias("along_km"), F.round(across, 5).alias("across_km"), F.round(F.greatest(F.lit(0), off - 75), 5).alias("penalty"))


@query("""
, c AS (SELECT icao, radians(lat) AS p, lon, k, 5e0 / 6371 * 10 AS d, radians(k * 5e0) AS c FROM ap, range(73) r(k)),
t AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(c)) AS y FROM c)
SELECT icao, k AS point, round(degrees(y), 6) AS lat, round(lon + degrees(atan2(sin(c) * sin(d) * cos(p), cos(d) - sin(p) * sin(y))), 6) AS lon FROM t""", (FLIGHTS,))
def circle_polygons(x: Frames) -> DataFrame:
    ring = x.airports().select("icao", F.posexplode(geo.circle(F.col("lat"), F.col("lon"), 50.0)).alias("point", "p"))
    return ring.select("icao", F.col("point").cast("long").alias("point"), F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query(f"""
, t AS (SELECT event_id, {_hav('0e0', '0e0', '0e0', '0e0')} AS zero, wind_from, ground_speed, radians(lat) AS p, lon, ground_speed * 5 / 60 / 3440.065e0 AS d5, least(8, event_id % 12) * ground_speed * 1.852e0 / 3600 / 6371 AS d8, radians(wind_from) AS c FROM obs),
u AS (SELECT *, asin(sin(p) * cos(d5) + cos(p) * sin(d5) * cos(c)) AS y5, asin(sin(p) * cos(d8) + cos(p) * sin(d8) * cos(c)) AS y8 FROM t)
SELECT event_id, round(degrees(y5), 6) AS lat5, round(lon + degrees(atan2(sin(c) * sin(d5) * cos(p), cos(d5) - sin(p) * sin(y5))), 6) AS lon5, round(degrees(y8), 6) AS lat_now, round(lon + degrees(atan2(sin(c) * sin(d8) * cos(p), cos(d8) - sin(p) * sin(y8))), 6) AS lon_now FROM u""", (OBSERVATIONS,))
def projected_positions(x: Frames) -> DataFrame:
    """Five minutes ahead in nautical miles, and dead-reckoned from a report at most eight seconds old."""
    lat, lon, track, speed = (F.col(c) for c in ("lat", "lon", "wind_from", "ground_speed"))
    lat5, lon5 = geo.destination(lat, lon, track, speed * 5 / 60, geo.EARTH_NM)
    lat8, lon8 = geo.destination(lat, lon, track, F.least(F.lit(8), F.col("event_id") % 12) * speed * 1.852 / 3600)
    return x.observations().select("event_id", F.round(lat5, 6).alias("lat5"), F.round(lon5, 6).alias("lon5"), F.round(lat8, 6).alias("lat_now"), F.round(lon8, 6).alias("lon_now"))


@query(f"""
, h AS (SELECT event_id, CAST(event_id * 10 % 360 AS DOUBLE) AS heading, wind_from, ground_speed AS v, radians({_turn('CAST(event_id * 10 % 360 AS DOUBLE)', 'wind_from')}) AS a FROM obs WHERE ground_speed > 0)
SELECT event_id, round({_turn('heading', 'wind_from')}, 6) AS turn, floor(v * cos(a) * 10 + 0.5) / 10 AS head_kt, abs(floor(abs(v * sin(a)) * 10 + 0.5)) / 10 AS cross_kt, round(CASE WHEN abs(heading - wind_from) > 180 THEN 360 - abs(heading - wind_from) ELSE abs(heading - wind_from) END, 6) AS apart FROM h""", (OBSERVATIONS,))
def runway_winds(x: Frames) -> DataFrame:
    o = x.observations().where("ground_speed > 0").withColumn("heading", (F.col("event_id") * 10 % 360).cast("double"))
    turn = geo.turn(F.col("heading"), F.col("wind_from"))
    head, _ = geo.runway_wind(F.col("heading"), F.col("wind_from"), F.col("ground_speed"))
    cross = F.floor(F.abs(F.col("ground_speed") * F.sin(F.radians(turn))) * 10 + 0.5) / 10
    return o.select("event_id", F.round(turn, 6).alias("turn"), head.alias("head_kt"), cross.alias("cross_kt"), F.round(F.abs(turn), 6).alias("apart"))


@query("""
, w AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id * 37 % 50 * 100 END AS ceiling, CASE WHEN event_id % 7 > 0 THEN event_id * 613 % 12000 END AS m, event_id % 2 = 0 AS less FROM obs),
r AS (SELECT *, CASE WHEN ceiling < 500 THEN 3 WHEN ceiling < 1000 THEN 2 WHEN ceiling <= 3000 THEN 1 ELSE 0 END AS a, CASE WHEN m / 1609.344e0 < 1 OR (less AND m / 1609.344e0 <= 1) THEN 3 WHEN m / 1609.344e0 < 3 THEN 2 WHEN m / 1609.344e0 <= 5 THEN 1 ELSE 0 END AS b FROM w)
SELECT event_id, CASE WHEN ceiling IS NOT NULL OR m IS NOT NULL THEN list_extract(['VFR', 'MVFR', 'IFR', 'LIFR'], greatest(a, b) + 1) END AS category FROM r""", (OBSERVATIONS,))
def flight_categories(x: Frames) -> DataFrame:
    k = F.col("event_id")
    ceiling, metres = F.when(k % 5 > 0, k * 37 % 50 * 100), F.when(k % 7 > 0, k * 613 % 12000)
    return x.observations().select("event_id", geo.flight_category(ceiling, metres, k % 2 == 0).alias("category"))


_SIDE = "abs(lat - lat0) / b + abs(lon - lon0) / a"


@query(f"""
, {SEC}, h AS (SELECT event_id, sector_id, CASE WHEN abs({_SIDE} - 1) < 1e-7 THEN 'boundary' ELSE 'inside' END AS side, upper_ft - lower_ft AS height FROM obs JOIN sectors ON {_SIDE} <= 1 + 1e-7 AND altitude_ft BETWEEN lower_ft AND upper_ft AND (valid_from IS NULL OR observed_at >= valid_from) AND (valid_to IS NULL OR observed_at <= valid_to))
SELECT event_id, sector_id, side, count(*) OVER (PARTITION BY event_id) AS matches FROM h QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY height, sector_id) = 1""", (OBSERVATIONS,))
def sector_match(x: Frames) -> DataFrame:
    return matching.sector_matches(x.observations(), x.sectors())


@query(f"""
, {SEC} SELECT event_id, sector_id, CASE WHEN abs({_SIDE} - 1) < 1e-7 THEN 'boundary' WHEN {_SIDE} > 1 THEN 'outside' WHEN abs(2 * ({_SIDE}) - 1) < 1e-7 THEN 'boundary' WHEN 2 * ({_SIDE}) < 1 THEN 'outside' ELSE 'inside' END AS side, round(lat0 - b, 6) AS south, round(lon0 + a, 6) AS east
FROM obs JOIN sectors ON sector_id = event_id % 25""", (OBSERVATIONS,))
def polygon_with_hole(x: Frames) -> DataFrame:
    """Each observation against one airspace whose inner half is a hole."""
    hole = F.transform("ring", lambda p: F.struct(((p["lat"] + F.col("lat0")) / 2).alias("lat"), ((p["lon"] + F.col("lon0")) / 2).alias("lon")))
    both = x.observations().join(x.sectors(), F.col("sector_id") == F.col("event_id") % 25)
    south, _, _, east = geo.ring_box(F.col("ring"))
    return both.select("event_id", "sector_id", geo.polygon_side(F.col("lat"), F.col("lon"), F.array("ring", hole)).alias("side"), F.round(south, 6).alias("south"), F.round(east, 6).alias("east"))


@query(f"""
, {SEG}, p AS (SELECT event_id, segment, wind_from AS track, lat, lon, lat1, lon1, lat2, lon2 FROM obs JOIN segments ON lat BETWEEN least(lat1, lat2) - 0.3 AND greatest(lat1, lat2) + 0.3 AND lon BETWEEN least(lon1, lon2) - 0.3 AND greatest(lon1, lon2) + 0.3),
s AS (SELECT *, {_segment()}, abs({_turn(_brg('lat1', 'lon1', 'lat2', 'lon2'), 'track')}) AS off FROM p),
k AS (SELECT *, round(CASE WHEN whole = 0 OR along <= 0 THEN near WHEN along >= whole THEN far ELSE abs(across) END, 6) AS km, round(least(off, 180 - off), 6) AS off_deg FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, segment) = 1)
SELECT event_id, segment, km, off_deg, CASE WHEN off_deg <= 20 THEN 'HIGH' WHEN off_deg <= 45 THEN 'MEDIUM' ELSE 'LOW' END AS alignment FROM k""", (OBSERVATIONS, FLIGHTS))
def nearest_segment(x: Frames) -> DataFrame:
    return matching.nearest_segments(x.observations().withColumn("track", F.col("wind_from")), x.segments())


@query(f", k AS (SELECT event_id, icao, round({_hav('obs.lat', 'obs.lon', 'ap.lat', 'ap.lon')}, 6) AS km FROM obs JOIN ap ON abs(obs.lat - ap.lat) <= 5 AND abs(obs.lon - ap.lon) <= 5) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, icao) = 1", (OBSERVATIONS, FLIGHTS))
def nearest_point(x: Frames) -> DataFrame:
    return matching.nearest_points(x.observations(), x.airports().select("icao", F.col("lat").alias("plat"), F.col("lon").alias("plon")))


@query(f"""
, n AS (SELECT event_id, icao_hex, icao, observed_at, wind_from AS track, altitude_ft / 10 - 1000 AS vr, round({_hav('obs.lat', 'obs.lon', 'ap.lat', 'ap.lon')}, 6) AS km, {_brg('obs.lat', 'obs.lon', 'ap.lat', 'ap.lon')} AS dir FROM obs, ap WHERE {_hav('obs.lat', 'obs.lon', 'ap.lat', 'ap.lon')} <= 30),
l AS (SELECT *, lag(km) OVER (PARTITION BY icao_hex, icao ORDER BY observed_at, event_id) - km AS closer, abs({_turn('dir', 'track')}) <= 65 AS toward, abs({_turn('(dir + 180)', 'track')}) <= 65 AS away FROM n)
SELECT event_id, icao, km, CASE WHEN closer IS NULL THEN 'unknown' WHEN closer >= 0.2 AND toward THEN 'approaching' WHEN closer <= -0.2 AND away AND vr >= 150 THEN 'departing' WHEN abs(closer) < 0.2 AND NOT toward AND NOT away THEN 'overflying' ELSE 'unknown' END AS kind FROM l""", (OBSERVATIONS, FLIGHTS))
def airport_movements(x: Frames) -> DataFrame:
    o = x.observations().withColumns({"track": F.col("wind_from"), "vertical_rate": F.col("altitude_ft") / 10 - 1000})
    return matching.movements(o, x.airports().select("icao", F.col("lat").alias("plat"), F.col("lon").alias("plon")))


#: Local targets, of which all but a third have an address that no network report has.
_TARGETS = "SELECT event_id, lat, lon, CASE WHEN event_id % 9 = 0 THEN icao_hex ELSE 'F' || substring(icao_hex, 2) END AS icao_hex FROM obs WHERE origin = 'local'"


@query(f"""
, a AS (SELECT icao_hex, lat, lon FROM obs WHERE origin = 'network' QUALIFY row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at DESC, event_id DESC) = 1)
SELECT event_id, icao_hex FROM ({_TARGETS}) t WHERE icao_hex NOT IN (SELECT icao_hex FROM a) AND NOT EXISTS (SELECT 1 FROM a WHERE {_hav('t.lat', 't.lon', 'a.lat', 'a.lon')} <= 0.3)""", (OBSERVATIONS,))
def target_duplicates(x: Frames) -> DataFrame:
    """All local targets against the last network report of every aircraft."""
    o = x.observations()
    last = o.where("origin = 'network'").groupBy("icao_hex").agg(F.max(F.struct("observed_at", "event_id", "lat", "lon")).alias("r")).select("icao_hex", "r.lat", "r.lon")
    return matching.without_duplicates(x.made(_TARGETS, obs=o), last).select("event_id", "icao_hex")


@query("""
, l AS (SELECT event_id, icao_hex, observed_at FROM obs WHERE origin = 'local'), r AS (SELECT icao_hex, observed_at, max(event_id) AS hi, min(event_id) AS lo FROM obs WHERE origin = 'network' GROUP BY 1, 2),
j AS (SELECT l.event_id, epoch_us(l.observed_at) AS us, epoch_us(b.observed_at) AS bt, b.hi AS be, epoch_us(a.observed_at) AS ft, a.lo AS fe FROM l ASOF LEFT JOIN r b ON l.icao_hex = b.icao_hex AND l.observed_at >= b.observed_at ASOF LEFT JOIN r a ON l.icao_hex = a.icao_hex AND l.observed_at <= a.observed_at),
t AS (SELECT event_id, CASE WHEN ft IS NULL OR us - bt <= ft - us THEN be ELSE fe END AS id, CASE WHEN ft IS NULL OR us - bt <= ft - us THEN us - bt ELSE ft - us END AS gap FROM j)
SELECT event_id, CASE WHEN gap <= 21600000000 THEN id END AS nearest_id, CASE WHEN gap = 0 THEN 'EXACT' WHEN gap <= 21600000000 THEN 'NEAREST_VALID' ELSE 'UNAVAILABLE' END AS match FROM t""", (OBSERVATIONS,))
def nearest_valid(x: Frames) -> DataFrame:
    o = x.observations()
    return matching.nearest_in_time(o.where("origin = 'local'"), o.where("origin = 'network'"), "icao_hex", "observed_at", 6 * 3600)


@query(f", {SEC} SELECT event_id, min(sector_id) AS first_sector, count(sector_id) AS valid FROM obs LEFT JOIN sectors ON valid_from IS NOT NULL AND observed_at >= valid_from AND observed_at < coalesce(valid_to, TIMESTAMP '2024-02-01 00:00:00') GROUP BY 1", (OBSERVATIONS,))
def interval_contains(x: Frames) -> DataFrame:
    """Which periods [from, to) hold the time of an observation."""
    periods = x.sectors().where("valid_from IS NOT NULL").select("sector_id", "valid_from", F.coalesce("valid_to", F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("until"))
    return matching.containing_periods(x.observations().select("event_id", "observed_at"), "observed_at", periods).groupBy("event_id").agg(F.min("sector_id").alias("first_sector"), F.count("sector_id").alias("valid"))


@query(f"""
, {SEC}, m AS (SELECT event_id, altitude_ft, sector_id, lat0, lon0, a, b, lower_ft, upper_ft, k, radians(lat) AS p, lat, lon, ground_speed * k / 60 / 3440.065e0 AS d, radians(wind_from) AS c FROM obs, sectors, range(16) r(k) WHERE (k = 0 OR ground_speed >= 30) AND altitude_ft BETWEEN lower_ft AND upper_ft),
q AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(c)) AS y FROM m),
z AS (SELECT *, CASE WHEN k = 0 THEN lat ELSE degrees(y) END AS y2, CASE WHEN k = 0 THEN lon ELSE lon + degrees(atan2(sin(c) * sin(d) * cos(p), cos(d) - sin(p) * sin(y))) END AS x2 FROM q)
SELECT event_id, sector_id, min(k) AS minute, CASE WHEN min(k) = 0 THEN 'current' ELSE 'projected' END AS relation FROM z WHERE abs(y2 - lat0) / b + abs(x2 - lon0) / a <= 1 + 1e-9 GROUP BY 1, 2""", (OBSERVATIONS,))
def hazard_context(x: Frames) -> DataFrame:
    return matching.hazards(x.observations().withColumn("track", F.col("wind_from")), x.sectors())


_REVISIONS = "rev AS (SELECT aircraft_id, start_time, flight_id, destination FROM (SELECT *, row_number() OVER (PARTITION BY aircraft_id ORDER BY start_time, flight_id) AS nth, row_number() OVER (PARTITION BY aircraft_id ORDER BY start_time DESC, flight_id DESC) AS back FROM (SELECT *, lag(destination) OVER (PARTITION BY aircraft_id ORDER BY start_time, flight_id) AS was FROM fl) WHERE was IS DISTINCT FROM destination) WHERE nth = 1 OR back < 8)"


@query(f", {_REVISIONS} SELECT * FROM rev", (FLIGHTS,))
def destination_revisions(x: Frames) -> DataFrame:
    return matching.revisions(x.flights(), "destination")


@query(f", {_REVISIONS} SELECT aircraft_id, arg_max(destination, (start_time, flight_id)) AS destination FROM rev WHERE start_time <= TIMESTAMP '1996-06-01' GROUP BY 1", (FLIGHTS,))
def destination_as_of(x: Frames) -> DataFrame:
    return matching.value_as_of(matching.revisions(x.flights(), "destination"), "destination", "1996-06-01")


@query("""
, m AS (SELECT l_orderkey * 10 + l_linenumber AS message_id, aircraft_id, callsign, start_time + to_minutes(CAST(l_linenumber * 50 - 90 AS INT)) AS sent_at FROM lineitem JOIN fl ON flight_id = l_orderkey)
SELECT flight_id, message_id, row_number() OVER (PARTITION BY flight_id ORDER BY sent_at DESC, message_id DESC) AS rank FROM fl JOIN m ON m.aircraft_id = fl.aircraft_id AND m.callsign = fl.callsign AND sent_at >= start_time - INTERVAL 1 HOUR AND sent_at <= least(last_seen_at + INTERVAL 10 MINUTE, start_time + INTERVAL 72 HOUR) QUALIFY rank <= 3""", (FLIGHTS,))
def flight_messages(x: Frames) -> DataFrame:
    f = x.flights()
    lines = x.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"), F.col("l_orderkey").alias("flight_id"), "l_linenumber")
    sent = F.timestamp_seconds(F.unix_seconds("start_time") + (F.col("l_linenumber") * 50 - 90) * 60)
    messages = lines.join(f.select("flight_id", "aircraft_id", "callsign", "start_time"), "flight_id").select("message_id", "aircraft_id", "callsign", sent.alias("sent_at"))
    return matching.messages_of_flights(f, messages, most=3)
