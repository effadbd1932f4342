"""Feed records to observations, and observations of two feeds to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import haversine_km
from .folds import by_chain


def usable(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def position_time(last_seen_us: Column, seen: Column, seen_pos: Column) -> Column:
    """Microseconds at which a position was observed; null without its age."""
    age = lambda c: F.when(c >= 0, c)
    return (last_seen_us + (F.coalesce(age(seen), F.lit(0.0)) - age(seen_pos)) * 1_000_000).cast("long")


def normalised(raw: DataFrame, now: str = "observed_at") -> DataFrame:
    """One row per record with a valid identifier; what is not a finite number or holds no text is null."""
    hex_, lat, lon = text.identifier(F.col("hex")), F.when(F.col("lat").between(-90, 90), F.col("lat")), F.when(F.col("lon").between(-180, 180), F.col("lon"))
    seen, seen_pos = (F.when(F.col(c) >= 0, F.col(c)) for c in ("seen", "seen_pos"))
    last = (F.unix_micros(now) - F.coalesce(seen, F.lit(0.0)) * 1_000_000).cast("long")
    return raw.where(hex_.isNotNull()).select(
        "event_id", hex_.alias("icao_hex"), text.clean_text(F.col("flight")).alias("callsign"), text.source_kind(F.col("kind"), F.col("mlat"), F.col("tisb")).alias("source"),
        F.coalesce(text.clean_number(F.col("alt_baro")), text.clean_number(F.col("alt_geom"))).alias("altitude_ft"), text.on_ground(F.col("ground"), F.col("alt_baro")).alias("on_ground"),
        text.emergency_state(F.col("emergency")).alias("emergency"), text.clean_text(F.col("squawk")).alias("squawk"), lat.alias("lat"), lon.alias("lon"), seen.alias("seen"), seen_pos.alias("seen_pos"),
        last.alias("last_seen_us"), position_time(last, seen, seen_pos).alias("position_us"), "ground_speed", "track", "origin",
    )


def newest(records: DataFrame, key: str = "icao_hex") -> DataFrame:
    """The last record of each key."""
    fields = [c for c in records.columns if c not in (key, "last_seen_us", "event_id")]
    return records.groupBy(key).agg(F.max(F.struct("last_seen_us", "event_id", *fields)).alias("r")).select(key, "r.*")


def merge_feeds(local: DataFrame, network: DataFrame, now_us: Column, local_ms: int = 15_000, network_ms: int = 30_000, tie_ms: int = 1_000) -> DataFrame:
    """One row per aircraft from the newest record of each feed, field by field.

    A usable local position stays; a network one counts while it is fresh. What moves
    comes from the side of the position, names from the local side first. Emergency and
    squawk come from a fresh record, the newer one if they are more than ``tie_ms``
    apart, the local one otherwise. ``now_us`` may use the columns l_* and n_*.
    """
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns))
    both = side(local, "l").join(side(network, "n"), F.col("l_icao_hex") == F.col("n_icao_hex"), "full").withColumn("now_us", now_us)
    age = lambda s: F.greatest(F.greatest(F.col("now_us") - F.col(f"{s}_last_seen_us"), F.lit(0)) / 1000, F.coalesce(F.col(f"{s}_seen"), F.lit(0.0)) * 1000)
    position_age = F.when(F.col("n_seen_pos").isNotNull(), F.greatest(F.col("n_seen_pos") * 1000, F.greatest(F.col("now_us") - F.col("n_position_us"), F.lit(0)) / 1000))
    has_local = usable(F.col("l_lat"), F.col("l_lon"))
    has_network = usable(F.col("n_lat"), F.col("n_lon")) & F.coalesce(position_age <= network_ms, F.lit(False))
    at = F.when(has_local, "local").when(has_network, "network")
    moves = F.coalesce(at, F.when(F.col("l_icao_hex").isNotNull(), "local").otherwise("network"))
    pick = lambda which, c: F.when(which == "local", F.col(f"l_{c}")).when(which == "network", F.col(f"n_{c}"))

    def fresh(field: str) -> Column:
        mine = F.col(f"l_{field}").isNotNull() & F.coalesce(age("l") <= local_ms, F.lit(False))
        theirs = F.col(f"n_{field}").isNotNull() & F.coalesce(age("n") <= network_ms, F.lit(False))
        return F.when(mine & theirs & (age("l") - age("n") > tie_ms), "network").when(mine, "local").when(theirs, "network")

    alarm = fresh("emergency")
    alarm_squawk = pick(alarm, "squawk")
    squawk = F.when(alarm_squawk.isin("7500", "7600", "7700"), alarm_squawk).otherwise(pick(fresh("squawk"), "squawk"))
    first = lambda c: F.coalesce(f"l_{c}", f"n_{c}").alias(c)
    seen_by = F.when(F.col("l_icao_hex").isNull(), "network").when(F.col("n_icao_hex").isNull(), "local").otherwise("overlap")
    return both.select(
        first("icao_hex"), seen_by.alias("membership"), first("callsign"), at.alias("position_origin"), pick(at, "lat").alias("lat"), pick(at, "lon").alias("lon"), pick(moves, "altitude_ft").alias("altitude_ft"),
        pick(moves, "ground_speed").alias("ground_speed"), pick(moves, "source").alias("source"), pick(moves, "on_ground").alias("on_ground"), pick(alarm, "emergency").alias("emergency"), squawk.alias("squawk"),
    )


def sessions(calls: DataFrame, minutes: int = 10) -> DataFrame:
    """Flights of each aircraft: a new one after a gap of more than ``minutes`` or another call sign.

    Attributes are the first that are known. A flight ends when it was last seen, or,
    if another call sign ended it, when that was; the last one is open. Its greatest
    altitude counts 0 as unknown once there are two rows.
    """

    def step(known: Column, row: Column) -> tuple[Column, Column]:
        renamed = F.coalesce(row["callsign"] != known["callsign"], F.lit(False))
        part = F.coalesce(known["part"], F.lit(0)) + renamed.cast("int")
        return F.struct(F.coalesce(row["callsign"], known["callsign"]).alias("callsign"), part.alias("part")), F.struct(renamed.alias("renamed"), part.alias("part"))

    # A gap of the very length ends nothing.
    rows = by_chain(calls.withColumn("at", F.unix_micros("observed_at")), ["icao_hex"], "observed_at", "event_id", minutes * 60 + 1e-6, "struct<callsign:string,part:int>", "struct<renamed:boolean,part:int>", step)
    rows = rows.withColumns({"renamed": F.col("decision.renamed"), "part": F.col("decision.part")})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "event_id"))).alias(c)
    highest = F.when(F.count("*") == 1, F.max("altitude_ft")).otherwise(F.nullif(F.max(F.coalesce("altitude_ft", F.lit(0))), F.lit(0)))
    flights = rows.groupBy("icao_hex", "chain", "part").agg(first("callsign"), first("aircraft_type"), F.count("*").alias("positions"), F.min("at").alias("start_us"), F.max("at").alias("last_us"), highest.alias("max_altitude"), F.min("distance_km").alias("min_distance_km"), F.max_by("renamed", F.struct(-F.col("at"), -F.col("event_id"))).alias("renamed"))
    flights = flights.withColumn("session", (F.row_number().over(Window.partitionBy("icao_hex").orderBy("chain", "part")) - 1).cast("long"))
    after = Window.partitionBy("icao_hex").orderBy("session")
    end = F.when(F.lead("renamed").over(after), F.lead("start_us").over(after)).when(F.lead("session").over(after).isNotNull(), F.col("last_us"))
    return flights.select("icao_hex", "session", "callsign", "aircraft_type", "positions", "start_us", F.coalesce(F.when(F.lead("renamed").over(after), end), F.col("last_us")).alias("last_seen_us"), end.alias("end_us"), "max_altitude", "min_distance_km")


def local_bounds(spark, days_before: int, now: str, zone: str) -> tuple[str, str]:
    """UTC instants of the local midnight ``days_before`` days before ``now``, and of now."""
    day = F.date_sub(F.to_date(F.from_utc_timestamp(F.lit(now).cast("timestamp"), zone)), days_before)
    row = spark.range(1).select(F.date_format(F.to_utc_timestamp(day.cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss").alias("a")).first()
    return row.a, now


def in_range(rows: DataFrame, at: str, name: str, now: str, zone: str) -> DataFrame:
    """Rows of today, yesterday, 7d or 30d in local days; the bounds are constants, so a scan can skip by them."""
    # Bounds of the column's own type reach the scan.
    bound = lambda text: F.lit(text).cast(rows.schema[at].dataType)
    if name == "yesterday":
        (first, _), (last, _) = local_bounds(rows.sparkSession, 1, now, zone), local_bounds(rows.sparkSession, 0, now, zone)
        return rows.where((F.col(at) >= bound(first)) & (F.col(at) < bound(last)))
    first, last = local_bounds(rows.sparkSession, {"today": 0, "7d": 6, "30d": 29}[name], now, zone)
    return rows.where((F.col(at) >= bound(first)) & (F.col(at) <= bound(last)))


def merge_lanes(records: DataFrame, lane: str = "lane") -> DataFrame:
    """One row per aircraft from the newest record of each network lane.

    The newest message wins, a later lane of equal ones; names that it lacks come from
    the next newest. A position is one whole: of the usable ones the last observed.
    """
    order = F.struct("last_seen_us", lane)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    place = F.max_by(F.struct("lat", "lon", "altitude_ft", "ground_speed", "track", "source"), F.when(usable(F.col("lat"), F.col("lon")), F.struct(F.coalesce("position_us", F.lit(-1)).alias("p"), "last_seen_us", lane))).alias("p")
    per = records.groupBy("icao_hex").agg(known("callsign"), known("squawk"), F.max("last_seen_us").alias("last_seen_us"), F.array_join(F.array_sort(F.collect_set(F.col(lane).cast("string"))), ",").alias("lanes"), place)
    return per.select("icao_hex", "callsign", "squawk", "last_seen_us", "lanes", "p.lat", "p.lon", "p.altitude_ft", "p.ground_speed", "p.source")


def merge_receiver(frames: DataFrame, summary: DataFrame, most_km: float = 25.0, fresh_s: float = 30.0, most_ft: float = 12_000) -> DataFrame:
    """One receiver's decoded frames and its own summary, by aircraft: of each field the fresher.

    An altitude that is more than ``most_ft`` from the summary's gives way to it, and so
    does a position more than ``most_km`` away while the summary's is fresh.
    """
    a, b = (df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns)) for df, s in ((frames, "f"), (summary, "s")))
    both = a.join(b, F.col("f_icao_hex") == F.col("s_icao_hex"), "full")
    newer = F.col("f_last_seen_us") >= F.col("s_last_seen_us")
    pick = lambda c: F.when(F.col(f"f_{c}").isNull(), F.col(f"s_{c}")).when(F.col(f"s_{c}").isNull() | newer, F.col(f"f_{c}")).otherwise(F.col(f"s_{c}"))
    altitude = F.when(F.abs(F.col("f_altitude_ft") - F.col("s_altitude_ft")) > most_ft, F.col("s_altitude_ft")).otherwise(pick("altitude_ft"))
    mine, theirs = usable(F.col("f_lat"), F.col("f_lon")), usable(F.col("s_lat"), F.col("s_lon"))
    apart = haversine_km(F.col("f_lat"), F.col("f_lon"), F.col("s_lat"), F.col("s_lon"))
    summary_first = ~mine | (theirs & F.coalesce(F.col("s_seen_pos") <= fresh_s, F.lit(False)) & (apart > most_km))
    place = lambda c: F.when(summary_first, F.when(theirs, F.col(f"s_{c}"))).otherwise(F.col(f"f_{c}")).alias(c)
    return both.select(F.coalesce("f_icao_hex", "s_icao_hex").alias("icao_hex"), *(pick(c).alias(c) for c in ("callsign", "squawk", "ground_speed")), altitude.alias("altitude_ft"), place("lat"), place("lon"))
