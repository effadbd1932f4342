"""Text feeds as column expressions: each line becomes a record or says why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Which senders are aircraft, by the name they address their packets to.
SENDERS = {
    "OGFLR": "flarm", "OGNFLR": "flarm", "OGFLR6": "flarm", "OGFLR7": "flarm", "OGNTRK": "ogn", "OGNT": "ogn", "OGNFNT": "fanet", "OGNSKY": "safesky", "OGPAW": "pilotaware", "OGNPAW": "pilotaware", "OGADSL": "ads_l",
}


def station_messages(lines: DataFrame, most: int = 4096) -> DataFrame:
    """Comma-separated station messages (column line): columns error, kind, icao_hex and what the message says.

    An error is one of too_long, malformed, invalid_icao, invalid_position; null if there is none.
    """
    # Each step's columns are read several times by the next, so each is computed once.
    keep = ("event_id", "observed_at")
    words = lines.select(*keep, F.length("line").alias("length"), F.split(F.trim("line"), ",", -1).alias("f"))
    at = lambda k: F.get("f", F.lit(k))
    trimmed = {"callsign": 10, "altitude_ft": 11, "ground_speed": 12, "lat": 14, "lon": 15, "squawk": 17}
    parts = words.select(*keep, "length", F.size("f").alias("size"), at(0).alias("type"), at(1).alias("kind"), F.upper(F.trim(at(4))).alias("icao_hex"), *(text.trimmed(at(k)).alias(c) for c, k in trimmed.items()), F.lower(F.trim(at(21))).alias("ground"))
    said = (F.col("lat") != "") | (F.col("lon") != "")
    numbers = parts.withColumns({"said": said, **{c: text.trimmed_number(F.col(c)) for c in ("altitude_ft", "ground_speed", "lat", "lon")}, "kind": F.when(F.col("kind").rlike("^[1-8]$"), F.col("kind").cast("int"))})
    lat, lon = F.when(F.col("lat").between(-90, 90), F.col("lat")), F.when(F.col("lon").between(-180, 180), F.col("lon"))
    error = F.when(F.col("length") > most, "too_long").when((F.col("size") < 22) | (F.col("type") != "MSG") | F.col("kind").isNull(), "malformed").when(~F.col("icao_hex").rlike("^[0-9A-F]{1,6}$"), "invalid_icao").when(F.col("said") & (lat.isNull() | lon.isNull()), "invalid_position")
    clean = lambda c: F.nullif(c, F.lit(""))
    fields = {"kind": F.col("kind"), "icao_hex": F.lpad("icao_hex", 6, "0"), "callsign": clean("callsign"), "altitude_ft": F.col("altitude_ft"), "ground_speed": F.col("ground_speed"), "lat": lat, "lon": lon, "squawk": clean("squawk"), "on_ground": F.col("ground").isin("-1", "true")}
    return numbers.withColumn("error", error).select(*keep, "error", *(F.when(F.col("error").isNull(), v).alias(k) for k, v in fields.items()))


def tracks(messages: DataFrame) -> DataFrame:
    """One track for each aircraft from partial messages: each field as it was last said, and when the position was."""
    # Wrong messages say nothing: no filter, which would parse every line once more.
    ok = F.col("error").isNull()
    order = F.struct("observed_at", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    place = F.max_by(F.struct("lat", "lon", "observed_at"), F.when(F.col("lat").isNotNull(), order))
    out = messages.groupBy("icao_hex").agg(F.count_if(ok).alias("messages"), last("callsign"), last("altitude_ft"), last("ground_speed"), last("squawk"), place.alias("p"), F.unix_micros(F.max(F.when(ok, F.col("observed_at")))).alias("last_us"))
    return out.where("messages > 0").select("icao_hex", "messages", "callsign", "altitude_ft", "ground_speed", "squawk", "p.lat", "p.lon", F.unix_micros("p.observed_at").alias("position_us"), "last_us")


_APRS = r"^([A-Z0-9-]{1,9})>([A-Z0-9]+),[^:]*:/([0-9]{6})h([0-9]{2})([0-9]{2}\.[0-9]{2})([NS])(.)([0-9]{3})([0-9]{2}\.[0-9]{2})([EW])(.)(?:([0-9]{3})/([0-9]{3}))?(.*)$"


def beacon_positions(lines: DataFrame, most: int = 512) -> DataFrame:
    """Position packets of small aircraft (column line): sender, kind of source, place, course, altitude, climb, or the reason against it."""
    part = lambda k: F.regexp_extract("line", _APRS, k)
    number = lambda k: part(k).try_cast("double")
    note = part(14)
    said = lambda pattern: F.nullif(F.regexp_extract(note, pattern, 1), F.lit("")).try_cast("double")
    source = F.create_map(*(F.lit(x) for pair in SENDERS.items() for x in pair))[part(2)]
    lat = (number(4) + number(5) / 60) * F.when(part(6) == "S", -1).otherwise(1)
    lon = (number(8) + number(9) / 60) * F.when(part(10) == "W", -1).otherwise(1)
    error = F.when(F.length("line") > most, "too_long").when(part(1) == "", "malformed").when(source.isNull(), "unknown_sender").when(~lat.between(-90, 90) | ~lon.between(-180, 180), "invalid_position")
    ident = F.regexp_extract(note, r" id([0-9A-F]{2})([0-9A-F]{6})", 2)
    flags = F.conv(F.nullif(F.regexp_extract(note, r" id([0-9A-F]{2})([0-9A-F]{6})", 1), F.lit("")), 16, 10).cast("long")
    fields = {"sender": part(1), "source": source, "lat": F.round(lat, 6), "lon": F.round(lon, 6), "course": number(12), "speed_kt": number(13), "altitude_ft": said("/A=(-?[0-9]{5,6})"), "climb_fpm": said(r" ([+-][0-9]+)fpm"), "address": F.nullif(ident, F.lit("")), "stealth": F.getbit(flags, F.lit(7)) == 1, "no_tracking": F.getbit(flags, F.lit(6)) == 1}
    return lines.withColumn("error", error).select("event_id", "error", *(F.when(F.col("error").isNull(), v).alias(k) for k, v in fields.items()))


def airport_rows(lines: DataFrame, types: tuple[str, ...] = ("large_airport", "medium_airport", "small_airport")) -> DataFrame:
    """Catalogue lines (ident, type, name, lat, lon, country): parsed, with the first reason against each."""
    r = F.from_csv("line", F.lit("ident string, type string, name string, lat string, lon string, country string"), {"quote": '"'})
    rows = lines.select("line_id", r.alias("r")).select("line_id", "r.*")
    lat, lon = text.clean_number(F.col("lat")), text.clean_number(F.col("lon"))
    reason = F.when(~F.coalesce(F.col("ident").rlike("^[A-Z0-9]{3,4}$"), F.lit(False)), "invalid_code").when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "type").when(lat.isNull() != lon.isNull(), "half_coordinates").when(~lat.between(-90, 90) | ~lon.between(-180, 180), "coordinates")
    return rows.select("line_id", "ident", "type", "name", lat.alias("lat"), lon.alias("lon"), "country", reason.alias("reason"))


def sync_plan(stored: DataFrame, new: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """What a full replacement would do: rows added, kept and removed, children without a parent."""
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return n(new.join(stored.select(key), key, "left_anti"), "added").unionByName(n(new.join(stored.select(key), key, "left_semi"), "kept")).unionByName(n(stored.join(new.select(key), key, "left_anti"), "removed")).unionByName(n(children.join(new.select(key), key, "left_anti"), "orphans"))


def closed_rows(stored: DataFrame, new: DataFrame, key: str, effective: str) -> DataFrame:
    """Stored rows that a new version does not have: valid until a millisecond before it takes effect."""
    gone = stored.join(new.select(key), key, "left_anti")
    return gone.withColumn("valid_to_ms", F.unix_millis(F.lit(effective).cast("timestamp")) - 1)


def weather_reports(lines: DataFrame) -> DataFrame:
    """Station reports from JSON text (column body): wind, visibility in metres and ceiling."""
    kind = "icaoId string, obsTime long, wdir string, wspd double, visib string, clouds array<struct<cover:string,base:double>>"
    r = lines.select("event_id", F.from_json("body", kind).alias("r")).select("event_id", "r.*")
    layers = F.filter("clouds", lambda c: F.upper(c["cover"]).isin("BKN", "OVC", "OVX", "VV") & (c["base"] >= 0))
    metres = F.floor(text.visibility_miles(F.col("visib")) * 1609.344 + 0.5)
    return r.select("event_id", "icaoId", "obsTime", F.col("wdir").try_cast("double").alias("wind_from"), F.col("wspd").alias("wind_kt"), metres.alias("visibility_m"), F.array_min(F.transform(layers, lambda c: c["base"])).alias("ceiling_ft"), F.coalesce(F.col("visib").startswith("M"), F.lit(False)).alias("less"))


def radar_frames(names: DataFrame, now: str, hours: int = 2, most: int = 25) -> DataFrame:
    """Frames of a listing (column name) by the time in their names: the newest of the last hours."""
    stamp = F.regexp_extract("name", r"_([0-9]{8})\.([0-9]{4})\.", 1)
    clock = F.regexp_extract("name", r"_([0-9]{8})\.([0-9]{4})\.", 2)
    at = F.try_to_timestamp(F.concat(stamp, clock), F.lit("yyyyMMddHHmm"))
    end = F.lit(now).cast("timestamp")
    frames = names.withColumn("at", at).where((F.col("at") <= end) & (F.col("at") >= end - F.expr(f"INTERVAL {hours} HOURS")))
    return frames.groupBy("at").agg(F.min("name").alias("name")).orderBy(F.desc("at")).limit(most).select("name", F.unix_seconds("at").alias("at_s"))


def newest_messages(messages: DataFrame, uid: str, key: str, at: str, most: int = 20) -> DataFrame:
    """Messages by their unique id once, and of each aircraft the newest."""
    once = messages.dropDuplicates([uid])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(uid)))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select(uid, key, F.col("rank").cast("long").alias("rank"))


def privacy(positions: DataFrame, registry: DataFrame, now: Column, found_s: int = 86_400, missing_s: int = 1_800) -> DataFrame:
    """What may be shown of a target: positions (address, stealth, no_tracking) by registry (address, tracked, identified, known, resolved_at)."""
    both = positions.join(registry, "address", "left")
    age = F.unix_seconds(now) - F.unix_seconds("resolved_at")
    status = F.when(F.col("resolved_at").isNull(), "unresolved").when(F.col("known") & (age <= found_s), "found").when(~F.col("known") & (age <= missing_s), "missing").otherwise("unresolved")
    decision = (
        F.when(F.col("no_tracking"), "drop:no-tracking").when(status == "unresolved", "drop:unresolved").when((status == "found") & (F.col("tracked") == "N"), "drop:not-tracked").when(status == "missing", "anonymous:missing")
        .when(F.col("stealth"), "anonymous:stealth").when(F.coalesce(F.col("identified") != "Y", F.lit(True)), "anonymous:not-identified").otherwise("identified")
    )
    return both.select("event_id", "address", decision.alias("decision"))


def planned_windows(plan: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """A day's plan (sequence, designator, day, from_clock, to_clock) under its updates (also revision, activity): the last one of a sequence counts, CNL deletes.

    Clocks before six belong to the next day; an end before the start is a day later.
    """
    both = plan.withColumns({"revision": F.lit(0), "activity": F.lit("")}).unionByName(updates)
    last = both.groupBy("sequence").agg(F.max(F.struct("revision", "designator", "day", "from_clock", "to_clock", "activity")).alias("r")).select("sequence", "r.*").where(~F.upper("activity").rlike(r"\bCNL\b"))

    def instant(clock: str) -> Column:
        hour, minute = F.split_part(clock, F.lit(":"), F.lit(1)).cast("int"), F.split_part(clock, F.lit(":"), F.lit(2)).cast("int")
        return F.unix_seconds(F.col("day").cast("timestamp")) + hour * 3600 + minute * 60 + F.when(hour < 6, 86_400).otherwise(0)

    start, end = instant("from_clock"), instant("to_clock")
    end = F.when(end < start, end + 86_400).otherwise(end)
    at = F.unix_seconds(F.lit(now).cast("timestamp"))
    return last.select("sequence", text.airspace_designator(F.col("designator")).alias("area"), start.alias("start_s"), end.alias("end_s"), ((start <= at) & (at < end)).alias("active"))


def plan_of_areas(areas: DataFrame, windows: DataFrame, now: str) -> DataFrame:
    """Each area (id, name) with its window: the active one of the highest sequence, or the next to come; by its id first, then its name."""
    at = F.unix_seconds(F.lit(now).cast("timestamp"))
    open_ = windows.where(F.col("end_s") > at)
    best = open_.groupBy("area").agg(F.min(F.struct((~F.col("active")).alias("later"), F.when(F.col("active"), F.lit(0)).otherwise(F.col("start_s")).alias("start"), (-F.col("sequence")).alias("back"))).alias("b")).select("area", (-F.col("b.back")).alias("sequence"), F.when(F.col("b.later"), "upcoming").otherwise("planned-now").alias("state"))
    keyed = areas.select("id", F.posexplode(F.array(text.airspace_designator(F.col("id")), text.airspace_designator(F.col("name")))).alias("place", "area")).join(best, "area")
    first = keyed.groupBy("id").agg(F.min(F.struct("place", "sequence", "state")).alias("k"))
    return areas.select("id").join(first, "id", "left").select("id", "k.sequence", "k.state")
