"""Receiver statistics and coverage from observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import azimuth, coverage_altitude, coverage_range, receiver_altitude
from .scans import carried, previous

KM_PER_NM = 1.852


def plausible() -> Column:
    return F.col("distance_km").between(0, 1000)


def daily_stats(obs: DataFrame) -> DataFrame:
    """Distinct aircraft, most aircraft in one hourly snapshot, and reach of each local day."""
    snapshots = obs.groupBy("day", F.date_trunc("hour", "observed_at").alias("h")).agg(F.countDistinct("icao_hex").alias("n")).groupBy("day").agg(F.max("n").alias("max_concurrent"))
    days = obs.groupBy("day").agg(F.countDistinct("icao_hex").alias("unique_aircraft"), F.max(F.when(plausible(), F.col("distance_km"))).alias("max_distance_km"))
    return days.join(snapshots, "day")


def trend(obs: DataFrame, first: str, last: str) -> DataFrame:
    """Every day of a range, null where nothing was seen."""
    spine = obs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    at = F.col("observed_at")
    near = obs.where((at >= F.date_sub(F.lit(first).cast("date"), 1).cast("timestamp")) & (at < F.date_add(F.lit(last).cast("date"), 2).cast("timestamp")))
    return spine.join(daily_stats(near), "day", "left")


def period_comparison(obs: DataFrame, first: str, last: str) -> DataFrame:
    """The range against as many days right before it."""
    first_day, last_day = F.lit(first).cast("date"), F.lit(last).cast("date")
    day = F.to_date("day")
    # A column of times beside the local day lets the scan skip: a day more on either side covers every zone.
    at = F.col("observed_at")
    obs = obs.where((at >= F.date_sub(first_day, F.datediff(last_day, first_day) + 2).cast("timestamp")) & (at < F.date_add(last_day, 2).cast("timestamp")))
    period = F.when(day.between(first_day, last_day), "current").when(day.between(F.date_sub(first_day, F.datediff(last_day, first_day) + 1), F.date_sub(first_day, 1)), "previous")
    return obs.withColumn("period", period).where("period IS NOT NULL").groupBy("period").agg(F.countDistinct("icao_hex").alias("unique_aircraft"), F.count("*").alias("positions"), F.max("distance_km").alias("max_distance_km"))


def azimuth_coverage(obs: DataFrame) -> DataFrame:
    """Reach in each of 36 sectors, 0 where nothing was seen."""
    reach = obs.where(plausible()).groupBy(azimuth(F.col("bearing")).alias("azimuth")).agg(F.max("distance_km").alias("max_distance_km"))
    return obs.sparkSession.range(36).select(F.col("id").alias("azimuth")).join(reach, "azimuth", "left").select("azimuth", F.coalesce("max_distance_km", F.lit(0.0)).alias("max_distance_km"))


def altitude_coverage(obs: DataFrame) -> DataFrame:
    return obs.where(plausible()).groupBy(azimuth(F.col("bearing")).alias("azimuth"), receiver_altitude(F.col("altitude_ft")).alias("band")).agg(F.max("distance_km").alias("max_distance_km"))


def sector_percentiles(obs: DataFrame) -> DataFrame:
    """Per sector, over its days' reach: days, median, nearest-rank 95th percentile, maximum."""
    daily = obs.where(plausible()).groupBy("day", azimuth(F.col("bearing")).alias("azimuth")).agg(F.max("distance_km").alias("reach"))
    return daily.groupBy("azimuth").agg(F.count("*").alias("days"), F.round(F.median("reach"), 6).alias("median_km"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY reach)").alias("p95_km"), F.max("reach").alias("max_km"))


def fastest(obs: DataFrame) -> DataFrame:
    """The fastest plausible observation of each day, the earliest of equals."""
    ok = obs.where(F.col("ground_speed").between(30, 700))
    best = ok.groupBy("day").agg(F.max(F.struct("ground_speed", (-F.unix_micros("observed_at")).alias("t"), (-F.col("event_id")).alias("e"), "icao_hex")).alias("b"))
    return best.select("day", "b.icao_hex", "b.ground_speed", (-F.col("b.e")).alias("event_id"))


def message_totals(obs: DataFrame) -> DataFrame:
    """A monotonic counter that may reset, to daily totals."""
    last = F.col("last.raw_messages")
    step = F.when(last.isNull(), 0).when(F.col("raw_messages") < last, F.col("raw_messages")).otherwise(F.col("raw_messages") - last)
    return carried(obs, ["icao_hex"], "observed_at", "event_id", last=previous(F.struct("raw_messages"))).withColumn("step", step).groupBy("day").agg(F.sum("step").cast("long").alias("messages"))


def capture_counters(obs: DataFrame) -> DataFrame:
    """Available and captured positions overall and by azimuth, range, altitude, and azimuth with range."""
    rows = obs.where(plausible()).select((F.col("origin") == "local").cast("long").alias("captured"), azimuth(F.col("bearing")).alias("azimuth"), coverage_range(F.col("distance_km") / KM_PER_NM).alias("band"), coverage_altitude(F.col("altitude_ft")).alias("level"))
    keyed = rows.select("captured", F.explode(F.array(F.lit("overall"), F.concat(F.lit("az:"), "azimuth"), F.concat(F.lit("range:"), "band"), F.concat(F.lit("alt:"), "level"), F.concat(F.lit("polar:"), "azimuth", F.lit(":"), "band"))).alias("bucket")).where("bucket IS NOT NULL")
    return keyed.groupBy("bucket").agg(F.count("*").alias("available"), F.sum("captured").alias("captured"))


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], width: float) -> DataFrame:
    """Values at given places of each key's sorted values: ranks are columns of the number of values, ``n``, from 0.

    First the bucket of ``width`` that holds a place is found from counts, then only
    that bucket is sorted, so no task gets all values of a key.
    """
    at = F.floor(F.col(value) / width)
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"), at.alias("_bucket"))
    counts = known.groupBy(*keys, "_bucket").agg(F.count("*").alias("_in"))
    by = Window.partitionBy(*keys)
    sums = counts.withColumns({"n": F.sum("_in").over(by), "_upto": F.sum("_in").over(by.orderBy("_bucket"))})
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    holding = sums.select(*keys, "_bucket", "_in", "_upto", wanted.alias("w")).where((F.col("w.rank") < F.col("_upto")) & (F.col("w.rank") >= F.col("_upto") - F.col("_in")))
    holding = holding.select(*keys, "_bucket", "w.name", (F.col("w.rank") - F.col("_upto") + F.col("_in")).alias("_place"))
    inside = known.join(holding.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi")
    ranked = inside.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_value")) - 1)
    found = ranked.join(holding, [*keys, "_bucket", "_place"])
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in ranks))


def receiver_quality(obs: DataFrame) -> DataFrame:
    """Median and 90th percentile by the index floor((n - 1) * f) of the sorted distances, per day."""
    n = F.col("n")
    picked = at_ranks(obs, ["day"], "distance_km", {"median_km": F.floor((n - 1) * 0.5), "p90_km": F.floor((n - 1) * 0.9)}, 1.0)
    return picked.join(obs.groupBy("day").agg(F.round(F.max("distance_km") / KM_PER_NM, 1).alias("max_nm")), "day")


def position_quality(reports: DataFrame, keys: list[str], fresh_s: float = 60.0) -> DataFrame:
    """Fresh and stale positions by their age, its median and 90th percentile by index, reach, and the state these give."""
    n = F.col("n")
    ages = reports.withColumn("age", F.greatest(F.col("seen_pos"), F.lit(0)).cast("double"))
    picked = at_ranks(ages, keys, "age", {"median_age": F.floor((n - 1) * 0.5), "p90_age": F.floor((n - 1) * 0.9)}, 1.0)
    per = ages.groupBy(*keys).agg(F.count_if(F.col("age") <= fresh_s).alias("fresh"), F.count_if(F.col("age") > fresh_s).alias("stale"), F.round(F.max("distance_km") / KM_PER_NM, 1).alias("max_nm"))
    return per.join(picked, keys, "left").withColumn("state", F.when(F.col("stale") > F.col("fresh"), "DEGRADED").otherwise("GOOD"))


def coverage_buckets(obs: DataFrame) -> DataFrame:
    """Counts by 10 degrees, 25 km and 5,000 ft."""
    return obs.groupBy((F.floor(F.pmod(F.col("bearing") + 360, F.lit(360.0)) / 10) * 10).alias("azimuth"), (F.floor(F.col("distance_km") / 25) * 25).alias("km"), (F.floor(F.col("altitude_ft") / 5000) * 5000).alias("feet")).agg(F.count("*").alias("positions"))


def day_aircraft(obs: DataFrame, field: str) -> DataFrame:
    """Each aircraft of a day with what was last known of it."""
    return obs.groupBy("day", "icao_hex").agg(F.max_by(field, F.when(F.col(field).isNotNull(), F.struct("observed_at", "event_id"))).alias(field), F.count("*").alias("positions"))


def best_sectors(obs: DataFrame, most: int = 5) -> DataFrame:
    """The sectors of the greatest reach, in order."""
    return azimuth_coverage(obs).where("max_distance_km > 0").orderBy(F.desc("max_distance_km"), "azimuth").limit(most)
