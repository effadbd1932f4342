"""Domain frames derived from the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bearing, haversine_km

RECEIVER = (50.0, 15.5)
ZONE = "Europe/Prague"


@dataclass
class Frames:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def observations(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """One row per received position, from ``since`` to before ``until`` (UTC): bounds that the scan skips by."""
        e = self.table("events")
        bound = lambda text: F.lit(text).cast(e.schema["ts"].dataType)
        if since is not None:
            e = e.where(F.col("ts") >= bound(since))
        if until is not None:
            e = e.where(F.col("ts") < bound(until))
        k = F.col("event_id")
        base = e.select(
            k, F.lpad(F.hex("user_id"), 6, "0").alias("icao_hex"), F.col("ts").cast("timestamp").alias("observed_at"),
            (49.0 + ((k * 7919) % 2000) / 1000.0).alias("lat"), (14.0 + ((k * 104729) % 4000) / 1000.0).alias("lon"),
            ((k * 37) % 420 * 100).alias("altitude_ft"), F.col("value").alias("ground_speed"), "event_type",
            F.when(k % 3 == 0, "local").otherwise("network").alias("origin"), ((k * 13) % 5000).alias("raw_messages"),
            ((k * 31) % 12).alias("nic"), ((k * 17) % 12).alias("nac_p"), ((k * 53) % 360).cast("double").alias("wind_from"),
        )
        at = (F.col("lat"), F.col("lon"), F.lit(RECEIVER[0]), F.lit(RECEIVER[1]))
        return base.withColumns({"distance_km": F.round(haversine_km(*at), 6), "bearing": F.round(bearing(at[2], at[3], at[0], at[1]), 6), "day": local_day(F.col("observed_at"))})

    def made(self, sql: str, **frames: DataFrame) -> DataFrame:
        """A frame that is arranged by SQL which DuckDB reads the same way, over other frames."""
        sql = sql.replace("{", "{{").replace("}", "}}")
        for name in frames:
            sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
        return self.spark.sql(sql, **frames)

    def raw(self) -> DataFrame:
        return self.made(RAW, obs=self.observations())

    def calls(self) -> DataFrame:
        return self.made(CALLS, obs=self.observations())

    def signals(self) -> DataFrame:
        return self.made(SIGNALS, obs=self.observations())

    def sectors(self) -> DataFrame:
        """Airspaces with a ring of (lat, lon), altitude limits and a time of validity."""
        s = self.made(SECTORS, nation=self.table("nation"))
        corner = lambda y, x: F.struct((F.col("lat0") + y * F.col("b")).alias("lat"), (F.col("lon0") + x * F.col("a")).alias("lon"))
        return s.withColumn("ring", F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)))

    def segments(self) -> DataFrame:
        return self.made(SEGMENTS, ap=self.airports())

    def lines(self) -> DataFrame:
        return self.made(LINES, obs=self.observations())

    def aircraft(self) -> DataFrame:
        n = self.table("nation")
        c = self.table("customer")
        return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("aircraft_id"), F.lpad(F.hex("c_custkey"), 6, "0").alias("icao_hex"), code(F.col("n_nationkey")).alias("country_code"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("operator"), F.col("c_name").alias("registration"))

    def flights(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        k = F.col("o_orderkey")
        start = F.col("o_orderdate").cast("timestamp")
        return o.join(c, "o_custkey").select(
            k.alias("flight_id"), F.col("o_custkey").alias("aircraft_id"), start.alias("start_time"),
            F.timestamp_seconds(F.unix_seconds(start) + k % 300 * 60).alias("last_seen_at"), F.col("o_orderpriority").alias("aircraft_type"),
            F.concat(F.lit("CS"), k % 50).alias("callsign"), F.col("o_orderstatus").alias("airline"), code(F.col("c_nationkey")).alias("origin"),
            code(k % 25).alias("destination"), F.nullif(k % 400 * 100, F.lit(0)).alias("max_altitude"), (F.col("o_totalprice") / 1000.0).alias("min_distance_km"),
        )

    def airports(self) -> DataFrame:
        k = F.col("n_nationkey").cast("long")
        return self.table("nation").select(code(k).alias("icao"), F.concat(F.lit("I"), F.lpad(k.cast("string"), 2, "0")).alias("iata"), F.col("n_name").alias("name"), (48.0 + k * 37 % 40 / 10.0).alias("lat"), (13.0 + k * 53 % 50 / 10.0).alias("lon"))


def code(key: Column) -> Column:
    return F.concat(F.lit("L"), F.lpad(key.cast("string"), 3, "0"))


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


# The same frames in SQL, for checking results.
OBSERVATIONS = """
obs0 AS (
  SELECT event_id, upper(lpad(to_hex(user_id), 6, '0')) AS icao_hex, ts AS observed_at,
    49e0 + ((event_id * 7919) % 2000) / 1000e0 AS lat, 14e0 + ((event_id * 104729) % 4000) / 1000e0 AS lon,
    (event_id * 37) % 420 * 100 AS altitude_ft, value AS ground_speed, event_type,
    CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'network' END AS origin, (event_id * 13) % 5000 AS raw_messages,
    (event_id * 31) % 12 AS nic, (event_id * 17) % 12 AS nac_p, CAST((event_id * 53) % 360 AS DOUBLE) AS wind_from,
    strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague', '%Y-%m-%d') AS day
  FROM events
), obs1 AS (
  SELECT *, power(sin(radians(50e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50e0)) * power(sin(radians(15.5e0 - lon) / 2), 2) AS a,
    degrees(atan2(sin(radians(lon - 15.5e0)) * cos(radians(lat)), cos(radians(50e0)) * sin(radians(lat)) - sin(radians(50e0)) * cos(radians(lat)) * cos(radians(lon - 15.5e0)))) AS t
  FROM obs0
), obs AS (
  SELECT * EXCLUDE (a, t), round(2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS distance_km,
    round(CASE WHEN t + 360 >= 360 THEN t ELSE t + 360 END, 6) AS bearing FROM obs1
)"""
FLIGHTS = """
air AS (
  SELECT c_custkey AS aircraft_id, upper(lpad(to_hex(c_custkey), 6, '0')) AS icao_hex, 'L' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS country_code,
    n_name AS country, c_mktsegment AS operator, c_name AS registration FROM customer JOIN nation ON c_nationkey = n_nationkey
), fl AS (
  SELECT o_orderkey AS flight_id, o_custkey AS aircraft_id, o_orderdate AS start_time, o_orderdate + to_minutes(o_orderkey % 300) AS last_seen_at,
    o_orderpriority AS aircraft_type, 'CS' || CAST(o_orderkey % 50 AS VARCHAR) AS callsign, o_orderstatus AS airline,
    'L' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS origin, 'L' || lpad(CAST(o_orderkey % 25 AS VARCHAR), 3, '0') AS destination,
    nullif(o_orderkey % 400 * 100, 0) AS max_altitude, o_totalprice / 1000e0 AS min_distance_km
  FROM orders JOIN customer ON o_custkey = c_custkey
), ap AS (
  SELECT 'L' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS icao, 'I' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iata, n_name AS name,
    48e0 + n_nationkey * 37 % 40 / 10e0 AS lat, 13e0 + n_nationkey * 53 % 50 / 10e0 AS lon FROM nation
)"""

#: Feed records as they come: padded, mixed and missing text.
RAW = """
SELECT event_id, observed_at, origin, ground_speed, wind_from AS track, lon,
  CASE event_id % 7 WHEN 0 THEN '~' || lower(icao_hex) WHEN 1 THEN ' ' || lower(icao_hex) || ' ' WHEN 2 THEN 'zz' || icao_hex ELSE lower(icao_hex) END AS hex,
  CASE event_id % 5 WHEN 0 THEN 'adsb_icao' WHEN 1 THEN ' MLAT' WHEN 2 THEN 'tisb_other' WHEN 3 THEN 'mode_s' END AS kind, event_id % 11 = 0 AS mlat, event_id % 13 = 0 AS tisb,
  CASE event_id % 6 WHEN 0 THEN 'Ground' WHEN 1 THEN '  ' || altitude_ft || ' ' WHEN 2 THEN 'Infinity' WHEN 3 THEN '' ELSE '' || altitude_ft END AS alt_baro,
  CASE event_id % 4 WHEN 0 THEN '0x1F40' WHEN 1 THEN '' || (altitude_ft + 150) || '.5' WHEN 2 THEN '1e4x' END AS alt_geom,
  CASE event_id % 9 WHEN 0 THEN '7700' WHEN 1 THEN '3' WHEN 2 THEN ' none ' WHEN 3 THEN 'Lifeguard' WHEN 4 THEN '7600 ' END AS emergency,
  CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN ' AIR' WHEN 2 THEN 'Ground' END AS ground, CASE event_id % 3 WHEN 0 THEN ' CS' || event_id % 50 || '  ' WHEN 1 THEN '   ' END AS flight,
  CASE WHEN event_id % 10 = 0 THEN lat + 100 ELSE lat END AS lat, (event_id % 40) / 2e0 - 1 AS seen, CASE WHEN event_id % 3 > 0 THEN (event_id % 60) * 1e0 END AS seen_pos,
  CASE WHEN event_id % 4 > 0 THEN '' || (1000 + event_id % 6777) END AS squawk
FROM obs"""
#: Observations with a call sign that is missing at times and changes in between.
CALLS = """
SELECT event_id, icao_hex, observed_at, CASE WHEN event_id % 4 > 0 THEN 'CS' || (altitude_ft / 100) % 2 END AS callsign, CASE WHEN event_id % 5 > 0 THEN altitude_ft END AS altitude_ft,
  CASE WHEN event_id % 6 > 0 THEN distance_km END AS distance_km, CASE WHEN event_id % 7 > 2 THEN 'T' || event_id % 9 END AS aircraft_type
FROM obs""".replace("(altitude_ft / 100) % 2", "event_id % 2")
#: Observations with integrity categories, some of them missing.
SIGNALS = """
SELECT event_id, icao_hex, observed_at, lat, lon, altitude_ft, upper(origin) AS source, CASE WHEN event_id % 8 > 0 THEN nic END AS nic, CASE WHEN event_id % 9 > 0 THEN nac_p END AS nac_p,
  CASE WHEN event_id % 3 > 0 THEN (event_id * 7) % 5 END AS nac_v, CASE WHEN event_id % 4 > 0 THEN (event_id * 5) % 4 END AS sil, CASE WHEN event_id % 5 > 1 THEN (event_id * 3) % 4 END AS sda,
  CASE WHEN event_id % 6 > 2 THEN (event_id * 11) % 4 END AS gva, event_id % 17 = 0 AS on_ground, CASE WHEN event_id % 19 > 0 THEN event_id % 60 END AS seen_pos, event_id % 100 AS telemetry_age
FROM obs"""

#: Airspaces as diamonds around a centre.
SECTORS = """
SELECT n_nationkey AS sector_id, 49e0 + (n_nationkey * 37 % 20) / 10e0 AS lat0, 14e0 + (n_nationkey * 53 % 40) / 10e0 AS lon0, 0.1e0 + (n_nationkey % 4) / 10e0 AS b, 0.2e0 + (n_nationkey % 3) / 10e0 AS a,
  n_nationkey % 5 * 5000 AS lower_ft, n_nationkey % 5 * 5000 + 12000 AS upper_ft, CASE n_nationkey % 3 WHEN 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS valid_from, CASE n_nationkey % 4 WHEN 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS valid_to
FROM nation"""
#: Route segments between airports.
SEGMENTS = "SELECT a.icao || '-' || b.icao AS segment, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM (SELECT *, lead(icao) OVER (ORDER BY icao) AS next FROM ap) a JOIN (SELECT * FROM ap) b ON a.next = b.icao"
#: Text lines of a message feed, some malformed.
LINES = """
SELECT event_id, observed_at, CASE event_id % 13 WHEN 0 THEN 'MSG,9' WHEN 1 THEN 'SEL,3' ELSE 'MSG,' || (1 + event_id % 8) END || ',1,1,' || CASE event_id % 11 WHEN 0 THEN 'XYZ' ELSE lower(substring(icao_hex, 3, 4)) END || ',1,,,,,' || CASE event_id % 3 WHEN 0 THEN ' CS' || event_id % 50 || ' ' ELSE '' END || ','
  || CASE event_id % 4 WHEN 0 THEN '' ELSE '' || altitude_ft END || ',' || CASE event_id % 5 WHEN 0 THEN '' ELSE '' || (event_id % 600) END || ',,' || CASE event_id % 6 WHEN 0 THEN ',' WHEN 1 THEN '91.5,15' ELSE '' || (49 + event_id % 2) || '.25,' || (14 + event_id % 3) || '.5' END || ',,' || CASE event_id % 9 WHEN 0 THEN '7700' ELSE '' END || CASE event_id % 17 WHEN 0 THEN ',0' ELSE ',0,0,0,' || CASE event_id % 7 WHEN 0 THEN '-1' ELSE '0' END END AS line
FROM obs"""
