"""Joins, filters and state changes of stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from .scans import carried, previous


def with_aircraft(flights: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Flights with their aircraft; what a flight does not say itself comes from there."""
    a = aircraft.select("aircraft_id", F.col("registration").alias("_registration"), F.col("operator").alias("_operator"), "icao_hex")
    return flights.join(a, "aircraft_id").withColumns({"registration": F.coalesce("registration", "_registration"), "operator": F.coalesce("operator", "_operator")}).drop("_registration", "_operator")


def find_flights(flights: DataFrame, aircraft: DataFrame, term: str, most: int = 100) -> DataFrame:
    """The newest flights where a term is part of the call sign, type, airline, origin or destination, or of the aircraft's registration or operator."""
    like = lambda c: F.col(c).ilike(f"%{term}%")
    own = flights.where(like("callsign") | like("aircraft_type") | like("airline") | like("origin") | like("destination"))
    theirs = flights.join(aircraft.where(like("registration") | like("operator")).select("aircraft_id"), "aircraft_id", "left_semi").select(*flights.columns)
    return own.unionByName(theirs).dropDuplicates(["flight_id"]).orderBy(F.desc("start_time"), F.desc("flight_id")).limit(most)


def map_filter(records: DataFrame, source: str = "all", status: str = "all", low: float | None = None, high: float | None = None, callsign: str = "", alarm_only: bool = False) -> DataFrame:
    """The aircraft that a map with these settings shows."""
    kinds = {"all": ("local", "network", "overlap"), "local": ("local", "overlap"), "network": ("network", "overlap"), "overlap": ("overlap",)}[source]
    keep = F.col("membership").isin(*kinds)
    if status != "all":
        keep &= F.col("on_ground") == (status == "onGround")
    if low is not None:
        keep &= F.col("altitude_ft") >= low
    if high is not None:
        keep &= F.col("altitude_ft") <= high
    if callsign:
        keep &= F.lower("callsign").contains(callsign.strip().lower())
    if alarm_only:
        keep &= F.col("emergency").isNotNull()
    return records.where(keep)


def matched_rules(aircraft: DataFrame, rules: list[tuple[int, str, str, float | None]]) -> DataFrame:
    """A row for each aircraft and rule (id, field or callsignPattern, value, greatest distance) that it meets."""

    def meets(kind: str, value: str, km: float | None) -> Column:
        wanted = value.strip().lower()
        if kind == "callsignPattern":
            hit = F.lower("callsign").rlike(text.wildcard(wanted)) if text.is_wildcard(wanted) else F.lit(False)
        else:
            hit = F.lower(F.trim(kind)) == wanted
        return hit & (F.col("distance_km") <= km) if km is not None else hit

    ids = F.array_compact(F.array(*(F.when(meets(*rule[1:]), F.lit(rule[0])) for rule in rules)))
    return aircraft.select("event_id", F.explode(ids).alias("rule_id"))


def weather_quality(samples: DataFrame) -> DataFrame:
    """REJECTED with the first reason, HIGH without an earlier sample, GOOD otherwise."""
    samples = carried(samples, ["icao_hex"], "observed_at", "event_id", last=previous(F.struct("event_id", "observed_at", "temperature_c", "wind_from", "wind_kt")))
    before = lambda c: F.col(f"last.{c}")
    # Times to the nearest millisecond.
    millis = lambda c: F.round(F.unix_micros(c), -3) / 1000
    elapsed = millis("observed_at") - millis(before("observed_at"))
    soon = (elapsed > 0) & (elapsed <= 15_000)
    off = lambda c, a, b: F.coalesce(~F.col(c).between(a, b), F.lit(False))
    spike = (F.abs(geo.turn(F.col("wind_from"), before("wind_from"))) > 150) & (F.abs(F.col("wind_kt") - before("wind_kt")) > 200)
    reason = F.when(off("altitude_ft", 0, 60_000), "ALTITUDE_RANGE").when(off("temperature_c", -100, 70), "TEMPERATURE_RANGE").when(off("wind_kt", 0, 512), "WIND_SPEED_RANGE").when(soon & (F.abs(F.col("temperature_c") - before("temperature_c")) > 50), "TEMPERATURE_JUMP").when(soon & spike, "WIND_SPIKE")
    rated = samples.withColumns({"reason": reason, "first": before("event_id").isNull()})
    return rated.select("event_id", F.when(F.col("reason").isNotNull(), "REJECTED").when(F.col("first"), "HIGH").otherwise("GOOD").alias("quality"), "reason")


def stable_altitude(obs: DataFrame, minutes: int = 30, spread_ft: int = 150) -> DataFrame:
    """Aircraft whose altitude in the last minutes hardly changed: the last altitude and the number of samples."""
    us = F.unix_micros("observed_at")
    known = obs.where("altitude_ft IS NOT NULL")
    # The latest times first: only what is recent is grouped then.
    recent = known.join(known.groupBy("icao_hex").agg(F.max(us).alias("end")), "icao_hex").where(us >= F.col("end") - minutes * 60_000_000)
    recent = recent.groupBy("icao_hex", "observed_at").agg(F.max_by("altitude_ft", "event_id").alias("altitude_ft"))
    per = recent.groupBy("icao_hex").agg(F.count("*").alias("samples"), F.max_by("altitude_ft", "observed_at").alias("altitude_ft"), (F.max(us) - F.min(us)).alias("length"), (F.max("altitude_ft") - F.min("altitude_ft")).alias("spread"))
    return per.where((F.col("samples") >= 3) & (F.col("length") >= 120_000_000) & (F.col("spread") <= spread_ft)).select("icao_hex", "altitude_ft", "samples")


def lifetime(flights: DataFrame) -> DataFrame:
    """Each aircraft over all time: flights, first and last sight, greatest altitude, days since its flight before the last."""
    order = Window.partitionBy("aircraft_id").orderBy("start_time", "flight_id")
    gap = F.floor((F.unix_seconds("start_time") - F.unix_seconds(F.lag("last_seen_at").over(order))) / 86_400)
    f = flights.withColumn("gap", gap)
    at = F.struct("start_time", "flight_id")
    return f.groupBy("aircraft_id").agg(F.count("*").alias("flights"), F.unix_seconds(F.min("start_time")).alias("first_s"), F.unix_seconds(F.max("last_seen_at")).alias("last_s"), F.max("max_altitude").alias("max_altitude"), F.countDistinct("callsign").alias("callsigns"), F.max_by("gap", at).alias("returning_days"), F.max_by("callsign", at).alias("last_callsign"))


def by_status(items: DataFrame, status: str, amount: str, at: str, key: str, failed: str) -> DataFrame:
    """Per status: how many, their sum, the newest; and the latest key of the failed ones."""
    return items.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("deliveries"), F.round(F.sum(amount), 2).alias("amount"), F.max(at).alias("newest"), F.max_by(F.when(F.col(status) == failed, F.col(key)), F.struct(at, key)).alias("latest_error"))


def retry_at(attempts: Column) -> Column:
    """Seconds until the next attempt: doubling from a second, at most a quarter of an hour."""
    return F.least(F.lit(900), F.pow(F.lit(2.0), F.least(attempts, F.lit(20)))).cast("long")


def next_delivery_state(queue: DataFrame, most: int = 8, stale_s: int = 300) -> DataFrame:
    """One poll of a queue (state, attempts, age_s): stale claims come back, due ones are claimed, spent ones fail."""
    due = F.col("state").isin("PENDING", "RETRY") & (F.col("age_s") >= F.when(F.col("attempts") == 0, 0).otherwise(retry_at(F.col("attempts"))))
    return queue.withColumn("next", F.when((F.col("state") == "CLAIMED") & (F.col("age_s") > stale_s), F.when(F.col("attempts") >= most, "FAILED").otherwise("RETRY")).when(due & (F.col("attempts") >= most), "FAILED").when(due, "CLAIMED").otherwise(F.col("state")))


def route_tokens(routes: DataFrame, known: list[str]) -> DataFrame:
    """The words of a route in order: direct, airway, waypoint or unknown."""
    t = F.upper("token")
    kind = F.when(t == "DCT", "DIRECT").when(t.rlike("^[A-Z][0-9]{1,3}[A-Z]?$"), "AIRWAY").when(t.isin(*known) | t.rlike("^[A-Z]{2,5}$"), "WAYPOINT").otherwise("UNKNOWN")
    words = routes.select("flight_id", F.posexplode(F.filter(F.split("route", r"\s+"), lambda w: w != "")).alias("place", "token"))
    return words.select("flight_id", F.col("place").cast("long").alias("place"), "token", kind.alias("kind"))


def route_status(tokens: DataFrame) -> DataFrame:
    """A route's share of resolved words and a confidence: 1 for airways, 0.72 for direct and waypoints."""
    hit = F.col("kind") != "UNKNOWN"
    per = tokens.groupBy("flight_id").agg(F.count("*").alias("n"), F.count_if(hit).alias("hit"), F.avg(F.when(F.col("kind") == "AIRWAY", 1.0).when(hit, 0.72)).alias("c"))
    return per.select("flight_id", F.round(F.col("hit") * 100 / F.col("n"), 1).alias("percent"), F.round("c", 6).alias("confidence"), F.when(F.col("hit") == F.col("n"), "RESOLVED").when(F.col("hit") > 0, "PARTIAL").otherwise("UNRESOLVED").alias("status"))


def apply_delta(state: DataFrame, changed: DataFrame, removed: DataFrame, key: str, sequence: int, expected: int) -> DataFrame:
    """A snapshot after a delta: changed rows replace, removed keys go. A repeated delta is ignored.

    Raises ValueError if deltas are missing between, or a key is in both parts.
    """
    if sequence == expected - 1:
        return state
    if sequence != expected:
        raise ValueError(f"delta {sequence} came instead of {expected}")
    if not changed.join(removed, key, "left_semi").isEmpty():
        raise ValueError("a key is both changed and removed")
    return state.join(changed.select(key).unionByName(removed.select(key)), key, "left_anti").unionByName(changed)


def membership_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that are missing now and those that are new."""
    gone = before.select(key).distinct().exceptAll(after.select(key).distinct()).withColumn("change", F.lit("missing"))
    return gone.unionByName(after.select(key).distinct().exceptAll(before.select(key).distinct()).withColumn("change", F.lit("recovered")))


def last_of(batches: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Rows of several batches by key: the last batch that has it wins."""
    whole = None
    for k, b in enumerate(batches):
        part = b.withColumn("_batch", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy(key).agg(F.max(F.struct("_batch", *fields)).alias("r")).select(key, *(F.col(f"r.{f}").alias(f) for f in fields))


def upsert_changed(stored: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored rows with new values where one is given, new keys added; ``written`` says which rows differ from what is stored."""
    a = stored.select(key, F.lit(True).alias("_old"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = a.join(new.select(key, *fields), key, "full")
    changed = ~F.coalesce("_old", F.lit(False))
    for f in fields:
        changed |= F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    return both.select(key, *(F.coalesce(f, f"_{f}").alias(f) for f in fields), changed.alias("written"))


def insert_new(stored: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of ``new`` that an insert adds: the first by ``order`` of each key that is not stored."""
    others = [c for c in new.columns if c not in (key, *order)]
    first = new.groupBy(key).agg(F.min(F.struct(*order, *others)).alias("_r"))
    return first.join(stored.select(key), key, "left_anti").select(key, "_r.*").select(*new.columns)


def retained(rows: DataFrame, at: str, now: str, days: int = 30) -> DataFrame:
    """Rows of the last days; the bound is a constant, so whole files are skipped by it."""
    return rows.where(F.col(at) >= F.lit(now).cast(rows.schema[at].dataType) - F.expr(f"INTERVAL {days} DAYS"))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as text lines: quoted where needed, blank for null."""

    def field(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.coalesce(F.when(value.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value), F.lit(""))

    return rows.select(F.array_join(F.array(*map(field, columns)), ",").alias("line"))


def public_view(obs: DataFrame, mode: str, lat: float, lon: float) -> DataFrame:
    """What others may see: without distance and bearing if the receiver is hidden, from its rounded place if it is approximate."""
    keep = ["event_id", "icao_hex", "lat", "lon", "altitude_ft"]
    if mode == "hidden":
        return obs.select(*keep, F.lit(None).cast("double").alias("distance_km"), F.lit(None).cast("double").alias("bearing"))
    if mode == "approximate":
        lat, lon = round(lat, 1), round(lon, 1)
    at = F.lit(lat), F.lit(lon)
    return obs.select(*keep, F.round(geo.haversine_km(*at, F.col("lat"), F.col("lon")), 5).alias("distance_km"), F.round(geo.bearing(*at, F.col("lat"), F.col("lon")), 5).alias("bearing"))


def monitoring(status: DataFrame) -> DataFrame:
    """State and advised action of receivers (offline, rate, position_age, aircraft)."""
    quiet, old = (F.col("rate") < 1) | (F.col("aircraft") == 0), F.col("position_age") > 60
    state = F.when(F.col("offline"), "OFFLINE").when(quiet | old, "DEGRADED").otherwise("HEALTHY")
    action = F.when(F.col("offline"), "CHECK_READSB").when(quiet, "CHECK_ANTENNA_OR_RF").when(old, "OBSERVE").otherwise("NONE")
    return status.withColumns({"state": state, "action": action})
