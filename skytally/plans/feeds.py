"""Queries of the text feeds and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import feeds
from ..sources.testdata import LINES, OBSERVATIONS, Frames
from .base import query

_MESSAGES = f"""
lines AS ({LINES}), f AS (SELECT *, string_split(trim(line), ',') AS f FROM lines),
m0 AS (SELECT *, upper(trim(f[5])) AS h, TRY_CAST(nullif(f[15], '') AS DOUBLE) AS y, TRY_CAST(nullif(f[16], '') AS DOUBLE) AS x FROM f),
m1 AS (SELECT *, CASE WHEN len(f) < 22 OR f[1] <> 'MSG' OR NOT regexp_full_match(f[2], '[1-8]') THEN 'malformed' WHEN NOT regexp_full_match(h, '[0-9A-F]{{1,6}}') THEN 'invalid_icao' WHEN (f[15] <> '' OR f[16] <> '') AND (y IS NULL OR x IS NULL OR y > 90) THEN 'invalid_position' END AS error FROM m0),
msg AS (SELECT event_id, observed_at, error, CASE WHEN error IS NULL THEN CAST(f[2] AS INT) END AS kind, CASE WHEN error IS NULL THEN lpad(h, 6, '0') END AS icao_hex, CASE WHEN error IS NULL THEN nullif(trim(f[11]), '') END AS callsign,
  CASE WHEN error IS NULL THEN TRY_CAST(nullif(f[12], '') AS DOUBLE) END AS altitude_ft, CASE WHEN error IS NULL THEN TRY_CAST(nullif(f[13], '') AS DOUBLE) END AS ground_speed, CASE WHEN error IS NULL THEN y END AS lat, CASE WHEN error IS NULL THEN x END AS lon,
  CASE WHEN error IS NULL THEN nullif(trim(f[18]), '') END AS squawk, CASE WHEN error IS NULL THEN f[22] = '-1' END AS on_ground FROM m1)"""
MSG = (OBSERVATIONS, _MESSAGES)


@query("SELECT * FROM msg", MSG)
def station_messages(x: Frames) -> DataFrame:
    return feeds.station_messages(x.lines())


def _last(c: str) -> str:
    return f"last({c} ORDER BY observed_at, event_id) FILTER ({c} IS NOT NULL) AS {c}"


@query(f"SELECT icao_hex, count(*) AS messages, {_last('callsign')}, {_last('altitude_ft')}, {_last('ground_speed')}, {_last('squawk')}, {_last('lat')}, {_last('lon')}, max(epoch_us(observed_at)) FILTER (lat IS NOT NULL) AS position_us, max(epoch_us(observed_at)) AS last_us FROM msg WHERE error IS NULL GROUP BY 1", MSG)
def station_tracks(x: Frames) -> DataFrame:
    return feeds.tracks(feeds.station_messages(x.lines()))


_BEACONS = """
SELECT event_id, 'FLR' || substring(icao_hex, 4, 3) || '>' || CASE event_id % 5 WHEN 0 THEN 'OGFLR' WHEN 1 THEN 'OGNTRK' WHEN 2 THEN 'OGNSDR' WHEN 3 THEN 'OGNFNT' ELSE 'APRS' END || ',qAS,LKTEST:/' || CASE event_id % 11 WHEN 0 THEN '07454' ELSE '074548' END || 'h49' || (10 + event_id % 49) || '.' || (10 + event_id % 89) || CASE event_id % 4 WHEN 0 THEN 'S' ELSE 'N' END || '/0' || (10 + event_id % 80) || (10 + event_id % 49) || '.' || (10 + event_id % 83) || CASE event_id % 3 WHEN 0 THEN 'W' ELSE 'E' END || ''''
  || CASE event_id % 6 WHEN 0 THEN '' ELSE (100 + event_id % 260) || '/' || (100 + event_id % 99) END || '/A=00' || (1000 + event_id % 8999) || CASE event_id % 7 WHEN 0 THEN ' !W12!' ELSE ' !W12! id' || CASE event_id % 9 WHEN 0 THEN '86' WHEN 1 THEN '46' ELSE '06' END || 'DDE' || (100 + event_id % 899) || ' ' || CASE event_id % 2 WHEN 0 THEN '-' ELSE '+' END || (100 + event_id % 400) || 'fpm +0.0rot' END AS line
FROM obs"""
_RE = r"'^([A-Z0-9-]+)>([A-Z0-9]+),[^:]*:/([0-9]{6})h([0-9]{2})([0-9.]{5})([NS])/([0-9]{3})([0-9.]{5})([EW]).(.*)$'"


@query(f"""
, b AS ({_BEACONS}), p AS (SELECT *, regexp_extract(line, {_RE}, 1) AS sender, regexp_extract(line, {_RE}, 2) AS dest, regexp_extract(line, ':/[^EW]*[EW].(.*)$', 1) AS note, TRY_CAST(regexp_extract(line, {_RE}, 4) AS DOUBLE) + TRY_CAST(regexp_extract(line, {_RE}, 5) AS DOUBLE) / 60 AS y, TRY_CAST(regexp_extract(line, {_RE}, 7) AS DOUBLE) + TRY_CAST(regexp_extract(line, {_RE}, 8) AS DOUBLE) / 60 AS x FROM b),
e AS (SELECT *, CASE WHEN sender = '' THEN 'malformed' WHEN dest NOT IN ('OGFLR', 'OGNTRK', 'OGNFNT') THEN 'unknown_sender' END AS error, regexp_extract(note, ' id(..)', 1) AS fl FROM p)
SELECT event_id, error, CASE WHEN error IS NULL THEN sender END AS sender, CASE WHEN error IS NULL THEN CASE dest WHEN 'OGFLR' THEN 'flarm' WHEN 'OGNTRK' THEN 'ogn' ELSE 'fanet' END END AS source, CASE WHEN error IS NULL THEN round(CASE WHEN line LIKE '%S/0%' THEN -y ELSE y END, 6) END AS lat, CASE WHEN error IS NULL THEN round(CASE WHEN event_id % 3 = 0 THEN -x ELSE x END, 6) END AS lon,
  CASE WHEN error IS NULL AND event_id % 6 > 0 THEN CAST(100 + event_id % 260 AS DOUBLE) END AS course, CASE WHEN error IS NULL AND event_id % 6 > 0 THEN CAST(100 + event_id % 99 AS DOUBLE) END AS speed_kt, CASE WHEN error IS NULL THEN CAST(1000 + event_id % 8999 AS DOUBLE) END AS altitude_ft, CASE WHEN error IS NULL AND event_id % 7 > 0 THEN CASE event_id % 2 WHEN 0 THEN -1e0 ELSE 1e0 END * (100 + event_id % 400) END AS climb_fpm,
  CASE WHEN error IS NULL AND fl <> '' THEN 'DDE' || (100 + event_id % 899) END AS address, CASE WHEN error IS NULL AND fl <> '' THEN fl = '86' END AS stealth, CASE WHEN error IS NULL AND fl <> '' THEN fl = '46' END AS no_tracking FROM e""", (OBSERVATIONS,))
def beacon_positions(x: Frames) -> DataFrame:
    return feeds.beacon_positions(x.made(_BEACONS, obs=x.observations()))


_CATALOGUE = "SELECT c_custkey AS line_id, CASE c_custkey % 7 WHEN 0 THEN 'lk1' ELSE 'K' || (100 + c_custkey % 899) END || ',' || CASE c_custkey % 5 WHEN 0 THEN 'heliport' ELSE 'small_airport' END || ',\"Field, no ' || c_custkey || '\",' || CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '95.5' ELSE '' || (c_custkey % 90) || '.5' END || ',' || CASE c_custkey % 9 WHEN 0 THEN '' ELSE '' || (c_custkey % 180) END || ',CZ' AS line, c_custkey FROM customer"
_IMPORT = f"""cat AS ({_CATALOGUE}), imp AS (SELECT line_id, CASE line_id % 7 WHEN 0 THEN 'lk1' ELSE 'K' || (100 + line_id % 899) END AS ident, CASE line_id % 5 WHEN 0 THEN 'heliport' ELSE 'small_airport' END AS type, 'Field, no ' || line_id AS name, CASE line_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 95.5e0 ELSE line_id % 90 + 0.5e0 END AS lat, CASE WHEN line_id % 9 > 0 THEN CAST(line_id % 180 AS DOUBLE) END AS lon, 'CZ' AS country FROM cat),
rated AS (SELECT *, CASE WHEN ident = 'lk1' THEN 'invalid_code' WHEN type = 'heliport' THEN 'type' WHEN (lat IS NULL) <> (lon IS NULL) THEN 'half_coordinates' WHEN lat > 90 THEN 'coordinates' END AS reason FROM imp)"""


def _airports(x: Frames) -> DataFrame:
    return feeds.airport_rows(x.made(_CATALOGUE, customer=x.table("customer")))


@query(f"WITH {_IMPORT} SELECT * FROM rated")
def airport_import(x: Frames) -> DataFrame:
    return _airports(x)


@query(f"WITH {_IMPORT} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS lines FROM rated GROUP BY 1")
def airport_rejects(x: Frames) -> DataFrame:
    return _airports(x).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("lines"))


@query(f"WITH {_IMPORT}, n AS (SELECT line_id AS k FROM rated WHERE reason IS NULL) SELECT 'added' AS what, count(*) AS n FROM n WHERE k NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'kept', count(*) FROM n WHERE k IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'removed', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM n) UNION ALL SELECT 'orphans', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM n)")
def import_plan(x: Frames) -> DataFrame:
    new = _airports(x).where("reason IS NULL").select(F.col("line_id").alias("k"))
    return feeds.sync_plan(x.table("supplier").select(F.col("s_suppkey").alias("k")), new, x.table("orders").select(F.col("o_custkey").alias("k")), "k")


@query(f"WITH {_IMPORT} SELECT s_suppkey AS k, epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - 1 AS valid_to_ms FROM supplier WHERE s_suppkey NOT IN (SELECT line_id FROM rated WHERE reason IS NULL)")
def import_closing(x: Frames) -> DataFrame:
    new = _airports(x).where("reason IS NULL").select(F.col("line_id").alias("k"))
    return feeds.closed_rows(x.table("supplier").select(F.col("s_suppkey").alias("k")), new, "k", "2024-02-01")


_STATIONS = """
SELECT event_id, '{"icaoId":"LK' || event_id % 99 || '","obsTime":' || (1704067200 + event_id * 60) || ',"wdir":' || CASE event_id % 4 WHEN 0 THEN '"VRB"' ELSE '' || (event_id * 10 % 360) END || ',"wspd":' || (event_id % 40) || ',"visib":' || CASE event_id % 5 WHEN 0 THEN '"6+"' WHEN 1 THEN '"M1/4SM"' WHEN 2 THEN '"1 1/2"' WHEN 3 THEN '10' ELSE 'null' END
  || ',"clouds":[{"cover":"FEW","base":400}' || CASE event_id % 3 WHEN 0 THEN ',{"cover":"bkn","base":' || (event_id % 90 * 100) || '},{"cover":"OVC","base":4000}' ELSE '' END || ']}' || CASE event_id % 50 WHEN 0 THEN 'x' ELSE '' END AS body
FROM obs WHERE event_id % 50 > 0""".replace(" || CASE event_id % 50 WHEN 0 THEN 'x' ELSE '' END", "").replace(" WHERE event_id % 50 > 0", "")


@query("""SELECT event_id, 'LK' || event_id % 99 AS "icaoId", 1704067200 + event_id * 60 AS "obsTime", CASE WHEN event_id % 4 > 0 THEN CAST(event_id * 10 % 360 AS DOUBLE) END AS wind_from, CAST(event_id % 40 AS DOUBLE) AS wind_kt, CAST(CASE event_id % 5 WHEN 0 THEN 9656 WHEN 1 THEN 402 WHEN 2 THEN 2414 WHEN 3 THEN 16093 END AS BIGINT) AS visibility_m, CASE WHEN event_id % 3 = 0 THEN CAST(least(4000, event_id % 90 * 100) AS DOUBLE) END AS ceiling_ft, event_id % 5 = 1 AS less FROM obs""", (OBSERVATIONS,))
def station_reports(x: Frames) -> DataFrame:
    return feeds.weather_reports(x.made(_STATIONS, obs=x.observations()))


@query("SELECT 'T_PABV23_C_OKPR_' || strftime(t, '%Y%m%d.%H%M') || '.hdf' AS name, CAST(epoch(t) AS BIGINT) AS at_s FROM (SELECT DISTINCT date_trunc('minute', observed_at) AS t FROM obs WHERE event_id % 20 > 0) WHERE t <= TIMESTAMP '2024-01-15 12:00:00' AND t >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY t DESC LIMIT 10", (OBSERVATIONS,))
def radar_frames(x: Frames) -> DataFrame:
    """Over half a day, as the test reports are far apart; names that hold no time are left out."""
    at = F.when(F.col("event_id") % 20 > 0, F.date_format("observed_at", "yyyyMMdd.HHmm")).otherwise(F.lit("latest"))
    return feeds.radar_frames(x.observations().select(F.concat(F.lit("T_PABV23_C_OKPR_"), at, F.lit(".hdf")).alias("name")), "2024-01-15 12:00:00", hours=12, most=10)


@query(", m AS (SELECT event_id AS uid, icao_hex, observed_at FROM obs UNION SELECT event_id, icao_hex, observed_at FROM obs WHERE origin = 'local') SELECT uid, icao_hex, row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at DESC, uid DESC) AS rank FROM m QUALIFY rank <= 20", (OBSERVATIONS,))
def newest_messages(x: Frames) -> DataFrame:
    m = x.observations().select(F.col("event_id").alias("uid"), "icao_hex", "observed_at", "origin")
    return feeds.newest_messages(m.unionAll(m.where("origin = 'local'")), "uid", "icao_hex", "observed_at")


_DEVICES = "SELECT DISTINCT icao_hex AS address, CASE WHEN lat_key % 3 = 0 THEN 'N' ELSE 'Y' END AS tracked, CASE WHEN lat_key % 4 = 0 THEN 'N' ELSE 'Y' END AS identified, lat_key % 5 > 0 AS known, CASE WHEN lat_key % 7 > 0 THEN TIMESTAMP '2024-01-31 00:00:00' END AS resolved_at FROM (SELECT icao_hex, max(event_id) AS lat_key FROM obs GROUP BY icao_hex) d"


@query(f"""
, dev AS ({_DEVICES}), p AS (SELECT event_id, icao_hex AS address, event_id % 13 = 0 AS stealth, event_id % 17 = 0 AS no_tracking, observed_at FROM obs),
j AS (SELECT p.*, tracked, identified, CASE WHEN resolved_at IS NULL THEN 'unresolved' WHEN known THEN 'found' ELSE 'unresolved' END AS st FROM p LEFT JOIN dev USING (address))
SELECT event_id, address, CASE WHEN no_tracking THEN 'drop:no-tracking' WHEN st = 'unresolved' THEN 'drop:unresolved' WHEN tracked = 'N' THEN 'drop:not-tracked' WHEN stealth THEN 'anonymous:stealth' WHEN identified <> 'Y' THEN 'anonymous:not-identified' ELSE 'identified' END AS decision FROM j""", (OBSERVATIONS,))
def target_privacy(x: Frames) -> DataFrame:
    """An hour after the registry was asked: what it knew still counts, what it missed no more."""
    o = x.observations()
    positions = o.select("event_id", F.col("icao_hex").alias("address"), (F.col("event_id") % 13 == 0).alias("stealth"), (F.col("event_id") % 17 == 0).alias("no_tracking"))
    return feeds.privacy(positions, x.made(_DEVICES, obs=o), F.lit("2024-01-31 01:00:00").cast("timestamp"))


_PLAN = "SELECT n_nationkey AS sequence, CASE n_nationkey % 3 WHEN 0 THEN 'TRA ' ELSE 'LKTSA' END || (1 + n_nationkey % 8) AS designator, DATE '2024-01-15' AS day, lpad('' || (n_nationkey * 5 % 24), 2, '0') || ':30' AS from_clock, lpad('' || (n_nationkey * 7 % 24), 2, '0') || ':00' AS to_clock FROM nation"
_UPDATES = "SELECT sequence, designator, day, CASE sequence % 4 WHEN 1 THEN '09:00' ELSE from_clock END AS from_clock, to_clock, 1 + sequence % 2 AS revision, CASE sequence % 4 WHEN 0 THEN 'cnl by unit' ELSE 'MIL' END AS activity FROM plan WHERE sequence % 4 < 2"
_WINDOWS = f"""plan AS ({_PLAN}), upd AS ({_UPDATES}),
cur AS (SELECT sequence, designator, from_clock, to_clock FROM plan WHERE sequence % 4 >= 2 UNION ALL SELECT sequence, designator, from_clock, to_clock FROM upd WHERE activity = 'MIL'),
t AS (SELECT *, CAST(left(from_clock, 2) AS INT) AS fh, CAST(left(to_clock, 2) AS INT) AS th, 1705276800 AS d0 FROM cur),
u AS (SELECT sequence, 'LK' || CASE WHEN designator LIKE 'TRA%' THEN 'TRA' ELSE 'TSA' END || right(designator, 1) AS area, d0 + fh * 3600 + CAST(right(from_clock, 2) AS INT) * 60 + CASE WHEN fh < 6 THEN 86400 ELSE 0 END AS start_s, d0 + th * 3600 + CASE WHEN th < 6 THEN 86400 ELSE 0 END AS e0 FROM t),
win AS (SELECT sequence, area, CAST(start_s AS BIGINT) AS start_s, CAST(CASE WHEN e0 < start_s THEN e0 + 86400 ELSE e0 END AS BIGINT) AS end_s FROM u)"""


def _windows(x: Frames) -> DataFrame:
    plan = x.made(_PLAN, nation=x.table("nation"))
    return feeds.planned_windows(plan, x.made(_UPDATES, plan=plan), "2024-01-15 12:00:00")


@query(f"WITH {_WINDOWS} SELECT *, start_s <= 1705320000 AND 1705320000 < end_s AS active FROM win")
def planned_windows(x: Frames) -> DataFrame:
    return _windows(x)


@query(f"""WITH {_WINDOWS}, a AS (SELECT *, start_s <= 1705320000 AS active FROM win WHERE end_s > 1705320000),
b AS (SELECT area, sequence, CASE WHEN active THEN 'planned-now' ELSE 'upcoming' END AS state FROM a QUALIFY row_number() OVER (PARTITION BY area ORDER BY active DESC, CASE WHEN active THEN 0 ELSE start_s END, sequence DESC) = 1),
s AS (SELECT id, d.sequence, d.state, n.sequence AS ns, n.state AS nst FROM (SELECT CASE n_nationkey % 2 WHEN 0 THEN 'lktra' || n_nationkey ELSE 'X' || n_nationkey END AS id, CASE n_nationkey % 2 WHEN 0 THEN 'LKTRA' || n_nationkey END AS c1, 'LKTSA' || n_nationkey % 9 AS c2 FROM nation) LEFT JOIN b d ON d.area = c1 LEFT JOIN b n ON n.area = c2)
SELECT id, coalesce(sequence, ns) AS sequence, coalesce(state, nst) AS state FROM s""")
def sector_plan(x: Frames) -> DataFrame:
    k = F.col("n_nationkey")
    areas = x.table("nation").select(F.when(k % 2 == 0, F.concat(F.lit("lktra"), k)).otherwise(F.concat(F.lit("X"), k)).alias("id"), F.concat(F.lit("TSA "), k % 9).alias("name"))
    return feeds.plan_of_areas(areas, _windows(x), "2024-01-15 12:00:00")
