"""Spatial, as-of and interval matching of observations with what is around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .scans import carried, last_known, next_known


def valid_at(at: Column, first: Column, last: Column) -> Column:
    """Inclusive at both ends; an open end is null."""
    return (first.isNull() | (at >= first)) & (last.isNull() | (at <= last))


def sector_matches(obs: DataFrame, sectors: DataFrame) -> DataFrame:
    """For each observation in a sector by place, altitude and time: the sector of the narrowest altitude range, then least id.

    Both sides meet by one-degree cell; the exact test follows.
    """
    reach = dict(zip(("s", "n", "w", "e"), geo.ring_reach(F.col("ring")), strict=True))
    covered = sectors.withColumns(reach).withColumn("cell", F.explode(geo.cell_cover(*map(F.col, reach))))
    both = obs.withColumn("cell", geo.cell(F.col("lat"), F.col("lon"))).join(covered, "cell").where(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")))
    inside = geo.ring_side(F.col("lat"), F.col("lon"), F.col("ring"))
    hits = both.where(F.col("altitude_ft").between(F.col("lower_ft"), F.col("upper_ft")) & valid_at(F.col("observed_at"), F.col("valid_from"), F.col("valid_to"))).withColumn("side", inside).where("side <> 'outside'")
    best = hits.groupBy("event_id").agg(F.min(F.struct((F.col("upper_ft") - F.col("lower_ft")).alias("height"), "sector_id", "side")).alias("b"), F.count("*").alias("matches"))
    return best.select("event_id", "b.sector_id", "b.side", "matches")


def nearest_segments(obs: DataFrame, segments: DataFrame, reach: float = 0.3) -> DataFrame:
    """The route segment nearest to each observation among those whose box, ``reach`` degrees wider, holds it."""
    lats, lons = (F.col("lat1"), F.col("lat2")), (F.col("lon1"), F.col("lon2"))
    box = F.least(*lats) - reach, F.greatest(*lats) + reach, F.least(*lons) - reach, F.greatest(*lons) + reach
    covered = segments.withColumns(dict(zip(("s", "n", "w", "e"), box, strict=True))).withColumn("cell", F.explode(geo.cell_cover(*box)))
    both = obs.withColumn("cell", geo.cell(F.col("lat"), F.col("lon"))).join(covered, "cell").where(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")))
    km = F.round(geo.segment_km(lats[0], lons[0], lats[1], lons[1], F.col("lat"), F.col("lon")), 6)
    course = geo.bearing(lats[0], lons[0], lats[1], lons[1])
    off = F.abs(geo.turn(course, F.col("track")))
    aligned = F.least(off, 180 - off)
    best = both.groupBy("event_id").agg(F.min(F.struct(km.alias("km"), "segment", F.round(aligned, 6).alias("off_deg"))).alias("b"))
    return best.select("event_id", "b.segment", "b.km", "b.off_deg", F.when(F.col("b.off_deg") <= 20, "HIGH").when(F.col("b.off_deg") <= 45, "MEDIUM").otherwise("LOW").alias("alignment"))


def nearest_points(obs: DataFrame, points: DataFrame, reach: float = 5.0) -> DataFrame:
    """The named point (icao, plat, plon) nearest to each observation within ``reach`` degrees.

    A cell's points are one array, so that an observation is one row throughout.
    """
    covered = points.withColumn("cell", F.explode(geo.cell_cover(F.col("plat") - reach, F.col("plat") + reach, F.col("plon") - reach, F.col("plon") + reach)))
    around = covered.groupBy("cell").agg(F.collect_list(F.struct("icao", "plat", "plon")).alias("around"))
    lat, lon = F.col("lat"), F.col("lon")
    near = F.filter("around", lambda p: (F.abs(lat - p["plat"]) <= reach) & (F.abs(lon - p["plon"]) <= reach))
    best = F.array_min(F.transform(near, lambda p: F.struct(F.round(geo.haversine_km(lat, lon, p["plat"], p["plon"]), 6).alias("km"), p["icao"].alias("icao"))))
    both = obs.select("event_id", "lat", "lon", geo.cell(lat, lon).alias("cell")).join(around, "cell").select("event_id", best.alias("b"))
    return both.groupBy("event_id").agg(F.min("b").alias("b")).where("b IS NOT NULL").select("event_id", "b.icao", "b.km")


def movements(obs: DataFrame, points: DataFrame, radius_km: float = 30.0) -> DataFrame:
    """Aircraft near an airport (icao, plat, plon): approaching, departing, overflying or unknown, from the last distance and the track."""
    wide = radius_km / 111.0
    covered = points.withColumn("cell", F.explode(geo.cell_cover(F.col("plat") - wide, F.col("plat") + wide, F.col("plon") - 2 * wide, F.col("plon") + 2 * wide)))
    both = obs.withColumn("cell", geo.cell(F.col("lat"), F.col("lon"))).join(covered, "cell")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    near = both.withColumns({"km": F.round(km, 6), "to": geo.bearing(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))}).where(F.col("km") <= radius_km)
    last = F.lag("km").over(Window.partitionBy("icao_hex", "icao").orderBy("observed_at", "event_id"))
    closer = last - F.col("km")
    toward = F.abs(geo.turn(F.col("to"), F.col("track"))) <= 65
    away = F.abs(geo.turn(F.col("to") + 180, F.col("track"))) <= 65
    kind = F.when(last.isNull(), "unknown").when((closer >= 0.2) & toward, "approaching").when((closer <= -0.2) & away & (F.col("vertical_rate") >= 150), "departing").when((F.abs(closer) < 0.2) & ~toward & ~away, "overflying").otherwise("unknown")
    return near.select("event_id", "icao", "km", kind.alias("kind"))


def without_duplicates(targets: DataFrame, aircraft: DataFrame, km: float = 0.3) -> DataFrame:
    """Targets that no aircraft (icao_hex, lat, lon) has the address of, or is within ``km`` of."""
    by_address = targets.join(aircraft.select("icao_hex"), "icao_hex", "left_anti")
    size = 0.02  # more than km in degrees, up to 80 degrees north
    spots = aircraft.select(F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    spots = spots.withColumn("cell", F.explode(geo.cell_cover(F.col("alat") - size, F.col("alat") + size, F.col("alon") - size, F.col("alon") + size, size)))
    near = by_address.withColumn("cell", geo.cell(F.col("lat"), F.col("lon"), size)).join(spots, "cell").where(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon")) <= km)
    return by_address.join(near.select("event_id").distinct(), "event_id", "left_anti")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, at: str, most_s: int) -> DataFrame:
    """Each left row with the nearest right one of its key, before or after it; the earlier of equals; none beyond ``most_s``."""
    sides = left.select(key, at, "event_id", F.lit(1).alias("_side")).unionByName(right.select(key, at, "event_id", F.lit(0).alias("_side")))
    mark = F.when(F.col("_side") == 0, F.struct(F.unix_micros(at).alias("us"), "event_id"))
    # Right rows of the same time come first, so they are before.
    found = carried(sides.withColumn("_tie", F.struct("_side", "event_id")), [key], at, "_tie", b=last_known(mark), a=next_known(mark))
    both = found.withColumn("us", F.unix_micros(at)).where("_side = 1")
    back, forth = F.col("us") - F.col("b.us"), F.col("a.us") - F.col("us")
    take = F.when(F.col("a").isNull() | (back <= forth), F.col("b")).otherwise(F.col("a"))
    gap = F.abs(F.col("us") - F.col("t.us"))
    out = both.withColumn("t", take)
    return out.select("event_id", F.when(gap <= most_s * 1_000_000, F.col("t.event_id")).alias("nearest_id"), F.when(gap <= most_s * 1_000_000, F.when(gap == 0, "EXACT").otherwise("NEAREST_VALID")).otherwise("UNAVAILABLE").alias("match"))


def hazards(obs: DataFrame, areas: DataFrame, minutes: int = 15) -> DataFrame:
    """Areas (sector_id, ring, lower_ft, upper_ft) that an aircraft is in, or by its track will be within ``minutes``: the first minute."""
    course = obs.select("event_id", "lat", "lon", "altitude_ft", "track", "ground_speed", F.explode(F.when(F.coalesce(F.col("ground_speed") >= 30, F.lit(False)), F.sequence(F.lit(0), F.lit(minutes))).otherwise(F.array(F.lit(0)))).alias("minute"))
    to_lat, to_lon = geo.destination(F.col("lat"), F.col("lon"), F.col("track"), F.col("ground_speed") * F.col("minute") / 60, geo.EARTH_NM)
    still = F.col("minute") == 0
    at = course.withColumns({"y": F.when(still, F.col("lat")).otherwise(to_lat), "x": F.when(still, F.col("lon")).otherwise(to_lon)})
    size = 0.5
    covered = areas.select("sector_id", "ring", "lower_ft", "upper_ft", *(c.alias(n) for c, n in zip(geo.ring_reach(F.col("ring")), "snwe", strict=True)))
    covered = covered.withColumn("cell", F.explode(geo.cell_cover(*map(F.col, "snwe"), size)))
    # The exact test is dear: altitude and box come first.
    beside = F.col("altitude_ft").between(F.col("lower_ft"), F.col("upper_ft")) & F.col("y").between(F.col("s"), F.col("n")) & F.col("x").between(F.col("w"), F.col("e"))
    both = at.withColumn("cell", geo.cell(F.col("y"), F.col("x"), size)).join(covered, "cell").where(beside)
    hit = both.where(geo.ring_side(F.col("y"), F.col("x"), F.col("ring")) != "outside")
    return hit.groupBy("event_id", "sector_id").agg(F.min("minute").cast("long").alias("minute")).withColumn("relation", F.when(F.col("minute") == 0, "current").otherwise("projected"))


def revisions(flights: DataFrame, value: str, most: int = 8) -> DataFrame:
    """The changes of a value over an aircraft's flights: runs of equal ones once, the first and the newest ``most - 1``."""
    order = Window.partitionBy("aircraft_id").orderBy("start_time", "flight_id")
    changed = flights.withColumn("was", F.lag(value).over(order)).where(F.col("was").isNull() | (F.col("was") != F.col(value)))
    ranked = changed.withColumns({"nth": F.row_number().over(order), "back": F.row_number().over(Window.partitionBy("aircraft_id").orderBy(F.desc("start_time"), F.desc("flight_id")))})
    return ranked.where((F.col("nth") == 1) | (F.col("back") < most)).select("aircraft_id", "start_time", "flight_id", value)


def value_as_of(changes: DataFrame, value: str, at: str) -> DataFrame:
    """The value that each aircraft had at an instant."""
    return changes.where(F.col("start_time") <= F.lit(at).cast("timestamp")).groupBy("aircraft_id").agg(F.max_by(value, F.struct("start_time", "flight_id")).alias(value))


def messages_of_flights(flights: DataFrame, messages: DataFrame, most: int = 30) -> DataFrame:
    """Messages of a flight's aircraft and call sign from an hour before its start to ten minutes after it was last seen (72 hours at most): the newest."""
    m = messages.select(F.col("message_id"), F.col("aircraft_id").alias("m_aircraft"), F.col("callsign").alias("m_callsign"), "sent_at")
    until = F.least(F.col("last_seen_at") + F.expr("INTERVAL 10 MINUTES"), F.col("start_time") + F.expr("INTERVAL 72 HOURS"))
    both = flights.join(m, (F.col("aircraft_id") == F.col("m_aircraft")) & (F.col("callsign") == F.col("m_callsign")) & (F.col("sent_at") >= F.col("start_time") - F.expr("INTERVAL 1 HOUR")) & (F.col("sent_at") <= until))
    rank = F.row_number().over(Window.partitionBy("flight_id").orderBy(F.desc("sent_at"), F.desc("message_id")))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).select("flight_id", "message_id", F.col("rank").cast("long").alias("rank"))


def containing_periods(rows: DataFrame, at: str, periods: DataFrame) -> DataFrame:
    """Rows with the periods (valid_from, until) that hold their time, the end excluded; they meet by day. Rows without one stay."""
    days = periods.withColumn("_day", F.explode(F.sequence(F.to_date("valid_from"), F.to_date("until"))))
    both = rows.withColumn("_day", F.to_date(at)).join(days, "_day").where((F.col(at) >= F.col("valid_from")) & (F.col(at) < F.col("until")))
    return rows.join(both.select("event_id", "sector_id"), "event_id", "left")
