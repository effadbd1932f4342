"""Coverage over hours and days: capture roll-ups, health against a baseline, reliable sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import azimuth, receiver_altitude


def hourly_capture(obs: DataFrame) -> DataFrame:
    """Columns hour, bucket, available, captured, providers: overall and by azimuth."""
    rows = obs.where(F.col("distance_km").between(0, 1000)).select(F.date_trunc("hour", "observed_at").alias("hour"), (F.col("origin") == "local").cast("long").alias("captured"), "event_type", F.explode(F.array(F.lit("overall"), F.concat(F.lit("azimuth:"), azimuth(F.col("bearing"))))).alias("bucket"))
    return rows.groupBy("hour", "bucket").agg(F.count("*").alias("available"), F.sum("captured").alias("captured"), F.array_sort(F.collect_set("event_type")).alias("providers"))


def roll_up(hourly: DataFrame) -> DataFrame:
    """All hours of a bucket: sums, the union of providers, the share captured in per cent."""
    all_ = hourly.groupBy("bucket").agg(F.sum("available").alias("available"), F.sum("captured").alias("captured"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("providers")))), ",").alias("providers"))
    return all_.withColumn("percent", F.round(F.least("captured", "available") * 100 / F.nullif("available", F.lit(0)), 6))


def merge_counts(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """An additive upsert: counts add up by hour and bucket, providers are united."""
    both = stored.unionByName(delta)
    return both.groupBy("hour", "bucket").agg(F.sum("available").alias("available"), F.sum("captured").alias("captured"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("providers")))).alias("providers"))


def _ratio(rows: Column, least: int) -> Column:
    """captured / available of the hours where ``rows`` holds, if there are enough."""
    available, captured = F.coalesce(F.sum(F.when(rows, F.col("available"))), F.lit(0)), F.coalesce(F.sum(F.when(rows, F.col("captured"))), F.lit(0))
    return F.when(available >= least, F.least(available, captured) / available)


def _hours(now: str, first: int, last: int) -> Column:
    """From ``first`` to before ``last`` hours before now; constants, so a scan can skip by them."""
    at = F.lit(now).cast("timestamp")
    return (F.col("hour") >= at - F.expr(f"INTERVAL {first} HOURS")) & (F.col("hour") < at - F.expr(f"INTERVAL {last} HOURS"))


def sector_health(hourly: DataFrame, now: str) -> DataFrame:
    """Each of 36 sectors: the last day's capture ratio against the week before."""
    kept = hourly.where(_hours(now, 192, 0) & F.col("bucket").startswith("azimuth:")).withColumn("sector", F.substring("bucket", 9, 2).cast("long"))
    ratios = kept.groupBy("sector").agg(_ratio(_hours(now, 24, 0), 40).alias("current"), _ratio(_hours(now, 192, 24), 200).alias("baseline"))
    both = hourly.sparkSession.range(36).select(F.col("id").alias("sector")).join(ratios, "sector", "left")
    delta = (F.col("current") - F.col("baseline")) * 100
    relative = F.when(F.col("baseline") > 0, F.col("current") / F.col("baseline")).otherwise(1.0)
    state = F.when(delta.isNull(), "INSUFFICIENT_DATA").when((delta <= -15) & (relative < 0.75), "DEGRADED").when((delta >= 15) & (F.col("current") > F.col("baseline")), "IMPROVED").otherwise("GOOD")
    return both.select("sector", F.round("current", 6).alias("current"), F.round("baseline", 6).alias("baseline"), F.round(delta, 6).alias("delta"), state.alias("state"))


def rolling_health(hourly: DataFrame, now: str) -> DataFrame:
    """One row: the receiver's state from the last 24 hours, the week before and the sectors."""
    overall = hourly.where(_hours(now, 192, 0) & (F.col("bucket") == "overall"))
    row = overall.agg(_ratio(_hours(now, 24, 0), 120).alias("current"), _ratio(_hours(now, 192, 24), 800).alias("baseline"), _ratio(_hours(now, 6, 0), 30).alias("last6h"), _ratio(_hours(now, 24, 6), 90).alias("previous18h"))
    sectors = sector_health(hourly, now).agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in (("DEGRADED", "degraded"), ("IMPROVED", "improved"))), F.count_if(F.col("state") != "INSUFFICIENT_DATA").alias("evaluated"))
    both = row.crossJoin(F.broadcast(sectors))  # one row each
    low = F.coalesce((F.col("current") - F.col("baseline")) * 100 <= -10, F.lit(False)) | (F.col("degraded") >= 3)
    recovering = F.coalesce(F.col("last6h") - F.col("previous18h") >= 0.08, F.lit(False))
    state = F.when(F.col("current").isNull() | F.col("baseline").isNull() | (F.col("evaluated") < 8), "INSUFFICIENT_DATA").when(low & recovering, "RECOVERING").when(low, "DEGRADED").otherwise("GOOD")
    return both.select(*(F.round(c, 6).alias(c) for c in ("current", "baseline", "last6h", "previous18h")), "degraded", "improved", "evaluated", state.alias("state"))


def daily_reach(obs: DataFrame) -> DataFrame:
    """Columns day, sector, reach."""
    ok = obs.where((F.col("distance_km") > 0) & (F.col("distance_km") <= 1000))
    return ok.groupBy("day", azimuth(F.col("bearing")).alias("sector")).agg(F.max("distance_km").alias("reach"))


def daily_health(obs: DataFrame, messages: DataFrame, today: str) -> DataFrame:
    """One row: the last whole day with 12 sectors or more against the median of up to seven before it."""
    reach = daily_reach(obs).groupBy("day").agg(F.median("reach").alias("range"), F.count("*").alias("sectors"))
    days = reach.join(obs.groupBy("day").agg(F.countDistinct("icao_hex").alias("aircraft")), "day").join(messages, "day", "left")
    # A row per day: the window over all of them is as long as the calendar.
    order = Window.orderBy(F.desc("day"))
    ranked = days.where((F.col("day") < today) & (F.col("sectors") >= 12)).withColumn("back", F.row_number().over(order) - 1).where("back <= 7")
    fields = ("range", "sectors", "aircraft", "messages")
    ratio = lambda c: (F.max(F.when(F.col("back") == 0, F.col(c))) / F.median(F.when((F.col("back") > 0) & (F.col(c) > 0), F.col(c)))).alias(c)
    row = ranked.agg(F.max(F.when(F.col("back") == 0, F.col("day"))).alias("day"), F.count_if(F.col("back") > 0).alias("baseline_days"), *(ratio(c) for c in fields))
    drops = sum((F.coalesce(F.col(c) < least, F.lit(False)).cast("int") for c, least in (("range", 0.75), ("sectors", 0.75), ("messages", 0.6))), F.lit(0))
    severe = F.coalesce(F.col("range") < 0.55, F.lit(False)) | F.coalesce(F.col("sectors") < 0.5, F.lit(False))
    state = F.when(F.col("day").isNull() | (F.col("baseline_days") < 3), "INSUFFICIENT_DATA").when(severe | (drops >= 2), "DEGRADED").otherwise("GOOD")
    return row.select("day", "baseline_days", *(F.round(F.when(F.col("baseline_days") >= 3, F.col(c)), 6).alias(f"{c}_ratio") for c in fields), state.alias("state"))


def reliable_sectors(obs: DataFrame, days: int) -> DataFrame:
    """Sectors over a range of days: share of days, median, nearest-rank p95 and p99, whether seen on half of them, and the best of these."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY reach)")
    per = daily_reach(obs).groupBy("sector").agg(F.count("*").alias("days"), F.median("reach").alias("median_km"), disc(0.95).alias("p95_km"), disc(0.99).alias("p99_km"), F.max("reach").alias("max_km"))
    reliable = F.col("days") >= -(-days // 2)
    best = F.row_number().over(Window.orderBy(F.desc(reliable), F.desc("median_km"), "sector")) == 1
    return per.select("sector", "days", F.round(F.col("days") * 100 / days, 1).alias("percent"), F.round("median_km", 6).alias("median_km"), "p95_km", "p99_km", "max_km", reliable.alias("reliable"), (best & reliable).alias("best"))


def altitude_band_sectors(obs: DataFrame) -> DataFrame:
    """Altitude bands: nearest-rank p95 and maximum of daily sector reach, days with any."""
    band = receiver_altitude(F.col("altitude_ft")).alias("band")
    daily = obs.where((F.col("distance_km") > 0) & (F.col("distance_km") <= 1000)).groupBy(band, "day", azimuth(F.col("bearing")).alias("sector")).agg(F.max("distance_km").alias("reach"))
    return daily.groupBy("band").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY reach)").alias("p95_km"), F.max("reach").alias("max_km"), F.countDistinct("day").alias("days"))


def total_messages(messages: DataFrame) -> DataFrame:
    """The sum over days; null if no day has a count."""
    return messages.agg(F.sum("messages").alias("messages"), F.count("messages").alias("days"))


def busiest_hour(flights: DataFrame, zone: str, most: int = 20_000) -> DataFrame:
    """The local hour with most starts, the earliest of equals; no answer beyond ``most`` flights, as the report says."""
    local = F.from_utc_timestamp("start_time", zone)
    hours = flights.groupBy(F.date_format(F.date_trunc("hour", local), "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("flights"))
    top = hours.agg(F.sum("flights").alias("all"), F.max(F.struct("flights", (-F.unix_seconds(F.to_timestamp("hour", "yyyy-MM-dd HH"))).alias("back"), "hour")).alias("top"))
    return top.select("all", F.when(F.col("all") <= most, F.col("top.hour")).alias("hour"), F.when(F.col("all") <= most, F.col("top.flights")).alias("flights"))


def source_counts(merged: DataFrame) -> DataFrame:
    """Aircraft seen locally, by the network, by both, by one alone."""
    n = lambda *kinds: F.count_if(F.col("membership").isin(*kinds))
    return merged.agg(n("local", "overlap").alias("local"), n("network", "overlap").alias("network"), n("overlap").alias("overlap"), n("local").alias("local_only"), n("network").alias("network_only"), F.count("*").alias("total"))


def eligible(network: DataFrame, local: DataFrame, now: str, radius_nm: float, fresh_s: int) -> DataFrame:
    """Fresh network aircraft in reach, and whether a fresh local record of them was there at the same time."""
    at = F.lit(now).cast("timestamp")
    fresh = lambda c: (F.col(c) <= at) & (F.col(c) >= at - F.expr(f"INTERVAL {fresh_s} SECONDS"))
    last = lambda df: df.where(fresh("observed_at")).groupBy("icao_hex").agg(F.max_by(F.struct("distance_km", "bearing", "altitude_ft"), F.struct("observed_at", "event_id")).alias("r"))
    seen = last(network.where(~F.col("icao_hex").rlike("^(~.*|0+)$"))).select("icao_hex", "r.*").where(F.col("distance_km") <= radius_nm * 1.852)
    return seen.join(last(local).select("icao_hex", F.lit(True).alias("captured")), "icao_hex", "left").withColumn("captured", F.coalesce("captured", F.lit(False)))
