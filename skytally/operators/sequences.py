"""Sessions, as-of joins, deltas and integrity baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import grid_cell, integrity_altitude, profile_bin
from ..functions.geo import wind_components
from .receiver import at_ranks
from .scans import carried, last_known, running_sum


def gap_sessions(obs: DataFrame, minutes: int = 10) -> DataFrame:
    """Flights: a new one after a gap of more than ``minutes``; an altitude of 0 counts as unknown."""
    # A gap of the very length ends nothing.
    window = F.session_window("observed_at", f"{minutes * 60_000_000 + 1} microseconds")
    flights = obs.groupBy("icao_hex", window.alias("w")).agg(F.count("*").alias("positions"), F.unix_micros(F.min("observed_at")).alias("start_us"), F.unix_micros(F.max("observed_at")).alias("end_us"), F.nullif(F.max("altitude_ft"), F.lit(0)).alias("max_altitude"), F.min("distance_km").alias("min_distance_km"))
    session = (F.row_number().over(Window.partitionBy("icao_hex").orderBy("start_us")) - 1).cast("long")
    return flights.select("icao_hex", session.alias("session"), "positions", "start_us", "end_us", "max_altitude", "min_distance_km")


def latest_before(reports: DataFrame, at: str, max_age_hours: int = 2, key: str = "icao_hex") -> DataFrame:
    """The last report of each station at an instant, if it is not too old."""
    instant = F.lit(at).cast("timestamp")
    fresh = reports.where((F.col("observed_at") <= instant) & (F.col("observed_at") >= instant - F.expr(f"INTERVAL {max_age_hours} HOURS")))
    return fresh.groupBy(key).agg(F.max_by(F.col("event_id"), F.struct("observed_at", "event_id")).alias("event_id"))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, taken: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it: one union, and windows of a key and day; no pairs."""
    sides = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    found = carried(sides, [key], at, "_side", _last=last_known(F.when(F.col("_side") == 0, F.struct(*taken))))
    return found.where("_side = 1").select(*[c for c in left.columns], *(F.col(f"_last.{c}").alias(f"asof_{c}") for c in taken))


def snapshot_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that were added, changed or removed between two snapshots; nulls count as values."""
    packed = lambda df, name: df.select(key, F.struct(*sorted(c for c in df.columns if c != key)).alias(name))
    both = packed(before, "old").join(packed(after, "new"), key, "full")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def merge_sources(local: DataFrame, network: DataFrame) -> DataFrame:
    """One row per aircraft: local fields first, then network ones; a usable local position wins as a whole."""
    a, b = local.alias("a"), network.alias("b")
    both = a.join(b, F.col("a.icao_hex") == F.col("b.icao_hex"), "full")
    has = F.col("a.lat").isNotNull() & F.col("a.lon").isNotNull()
    place = lambda c: F.when(has, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    origin = F.when(F.col("a.icao_hex").isNull(), "network").when(F.col("b.icao_hex").isNull(), "local").otherwise("overlap")
    return both.select(F.coalesce("a.icao_hex", "b.icao_hex").alias("icao_hex"), origin.alias("membership"), place("lat"), place("lon"), F.coalesce("a.altitude_ft", "b.altitude_ft").alias("altitude_ft"))


def lane_value(obs: DataFrame, lane: str = "lane", key: str = "icao_hex") -> DataFrame:
    """Aircraft by the set of lanes (numbers from 0) that saw them."""
    lanes = obs.groupBy(key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(lane).cast("int"))).alias("lanes"))
    return lanes.groupBy("lanes").agg(F.count("*").alias("aircraft"), F.max(F.bit_count("lanes").cast("long")).alias("n_lanes"))


def weather_profile(obs: DataFrame, bin_ft: int = 2000) -> DataFrame:
    """Wind by altitude: vector mean of each aircraft, then of the aircraft."""
    east, north = wind_components(F.col("wind_from"), F.col("ground_speed"))
    one = obs.withColumns({"bin": profile_bin(F.col("altitude_ft"), bin_ft), "u": east, "v": north}).groupBy("bin", "icao_hex").agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.count("*").alias("n"))
    return one.groupBy("bin").agg(F.count("*").alias("aircraft"), F.sum("n").alias("samples"), F.round(F.avg("u"), 6).alias("east"), F.round(F.avg("v"), 6).alias("north"))


def integrity_baseline(obs: DataFrame, low: int = 6) -> DataFrame:
    """Per grid cell and altitude band: samples, aircraft, 15-minute buckets, median category, share below ``low``."""
    lat, lon = grid_cell(F.col("lat"), F.col("lon"))
    cells = obs.withColumns({"lat_cell": lat, "lon_cell": lon, "band": integrity_altitude(F.col("altitude_ft"))})
    return cells.groupBy("lat_cell", "lon_cell", "band").agg(F.count("*").alias("samples"), F.countDistinct("icao_hex").alias("aircraft"), F.countDistinct(F.floor(F.unix_seconds("observed_at") / 900)).alias("buckets"), F.median("nic").alias("median_nic"), F.round(F.count_if(F.col("nic") < low) / F.count("*"), 6).alias("low_share"))


def delivery_health(items: DataFrame, status: str, at: str, key: str) -> DataFrame:
    """Per status: how many, and the key of the newest."""
    return items.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("deliveries"), F.max_by(key, F.struct(at, key)).alias("latest"))


def retry_schedule(attempts: int = 12) -> list[int]:
    """Seconds before each retry: doubling from one second, at most a quarter of an hour."""
    return [min(900, 2**k) for k in range(attempts)]


def import_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Added, updated, unchanged and obsolete rows of two catalogue versions."""
    both = old.select(F.col(key), F.col(value).alias("was"), F.lit(True).alias("a")).join(new.select(F.col(key), F.col(value).alias("now"), F.lit(True).alias("b")), key, "full")
    return both.select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "obsolete").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("updated").alias("change"))


def latency_window(events: DataFrame, kind: str = "event_type", value: str = "value") -> DataFrame:
    """Nearest-rank percentiles of a measurement for each kind of event."""
    rank = lambda p: F.ceil(F.col("n") * p) - 1
    picked = at_ranks(events, [kind], value, {"p50": rank(0.5), "p95": rank(0.95), "p99": rank(0.99)}, 1.0)
    return events.groupBy(kind).agg(F.count("*").alias("probes"), F.max(value).alias("worst")).join(picked, kind)


def incident_flags(events: DataFrame, limit: float, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Degraded: three of the last five probes beyond the limit; critical: the last three."""
    order = Window.partitionBy(key).orderBy(at, "event_id")
    breach = (F.col("value") > limit).cast("long")
    flagged = events.withColumns({"five": F.sum(breach).over(order.rowsBetween(-4, 0)), "three": F.sum(breach).over(order.rowsBetween(-2, 0))})
    return flagged.select("event_id", F.when(F.col("three") == 3, "critical").when(F.col("five") >= 3, "degraded").otherwise("ok").alias("state"))


def downsample(obs: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key: both ends and evenly spaced ones between, by position."""
    ranked = carried(obs, [key], "observed_at", "event_id", _nth=running_sum(F.lit(1))).withColumn("i", F.col("_nth") - 1).join(obs.groupBy(key).agg(F.count("*").alias("n")), key)
    # Row i is taken if some j in 0..most-1 has floor(j * (n - 1) / (most - 1) + 0.5) = i.
    j = F.floor((F.col("i") - 0.5) * (most - 1) / (F.col("n") - 1))
    at = lambda x: F.floor(x * (F.col("n") - 1) / (most - 1) + 0.5)
    taken = (F.col("n") <= most) | (at(j) == F.col("i")) | (at(j + 1) == F.col("i"))
    return ranked.where(taken).select(key, "event_id", F.col("i").cast("long").alias("i"))


def incidents(events: DataFrame, limit: float, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Runs of probes that are beyond the limit or degraded: when they opened, last were seen and were resolved, their worst state."""
    order = Window.partitionBy(key).orderBy(at, "event_id")
    breach = (F.col("value") > limit).cast("long")
    rows = events.withColumns({"five": F.sum(breach).over(order.rowsBetween(-4, 0)), "three": F.sum(breach).over(order.rowsBetween(-2, 0)), "bad": breach == 1})
    rows = rows.withColumn("rank", F.when(F.col("three") == 3, 3).when(F.col("five") >= 3, 2).when(F.col("bad"), 1).otherwise(0))
    rows = rows.withColumn("starts", ((F.col("rank") > 0) & (F.coalesce(F.lag("rank").over(order), F.lit(0)) == 0)).cast("long"))
    rows = rows.withColumns({"incident": F.sum("starts").over(order), "following": F.lead("event_id").over(order)}).where("rank > 0")
    severity = F.element_at(F.array(*map(F.lit, ("warning", "degraded", "critical"))), F.max("rank"))
    last = F.struct(at, "event_id")
    return rows.groupBy(key, "incident").agg(F.count("*").alias("occurrences"), F.min_by("event_id", last).alias("first_id"), F.max_by("event_id", last).alias("last_id"), F.max_by("following", last).alias("resolved_id"), severity.alias("severity"))
