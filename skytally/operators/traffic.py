"""Rankings and histories of flights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text


def top_names(rows: DataFrame, name: Column, k: int = 8, count: Column | None = None) -> DataFrame:
    """The k most frequent names, count first and then name; names are cleaned before they are grouped."""
    counted = rows.select(F.upper(clean_text(name)).alias("name"), (count if count is not None else F.lit(1)).alias("n")).where("name IS NOT NULL")
    return counted.groupBy("name").agg(F.sum("n").cast("long").alias("flights")).orderBy(F.desc("flights"), "name").limit(k)


def top_routes(flights: DataFrame, k: int = 8) -> DataFrame:
    known = flights.where("origin IS NOT NULL AND destination IS NOT NULL")
    return known.groupBy("origin", "destination").agg(F.count("*").alias("flights")).orderBy(F.desc("flights"), "origin", "destination").limit(k)


def with_aircraft(flights: DataFrame, aircraft: DataFrame, label: Column, k: int = 8) -> DataFrame:
    """Ranking by an attribute of the aircraft: flights are counted by aircraft before the join."""
    counts = flights.groupBy("aircraft_id").agg(F.count("*").alias("n"))
    return top_names(counts.join(aircraft, "aircraft_id"), label, k, F.col("n"))


def country_label() -> Column:
    return F.when(F.upper("country") == F.col("country_code"), F.col("country")).otherwise(F.concat_ws(" · ", "country_code", "country"))


def history_summary(flights: DataFrame, zone_day) -> DataFrame:
    """For each aircraft: flights, active local days, longest gap in whole days, highest altitude, nearest pass."""
    per = Window.partitionBy("aircraft_id").orderBy("start_time", "flight_id")
    gap = F.floor((F.unix_seconds("start_time") - F.unix_seconds(F.lag("last_seen_at").over(per))) / 86400)
    days = flights.select("aircraft_id", F.explode(F.sequence(F.to_date(zone_day(F.col("start_time"))), F.to_date(zone_day(F.col("last_seen_at"))))).alias("d"))
    active = days.groupBy("aircraft_id").agg(F.countDistinct("d").alias("active_days"))
    totals = flights.withColumn("gap", gap).groupBy("aircraft_id").agg(F.count("*").alias("flights"), F.max("gap").alias("longest_gap_days"), F.max("max_altitude").alias("max_altitude"), F.min("min_distance_km").alias("min_distance_km"))
    return totals.join(active, "aircraft_id")


def logbook_labels(flights: DataFrame, rare: int = 3, returning_days: int = 30) -> DataFrame:
    per = Window.partitionBy("aircraft_id").orderBy(F.desc("start_time"), F.desc("flight_id"))
    latest = flights.withColumns({"rank": F.row_number().over(per), "previous": F.lead("last_seen_at").over(per), "n": F.count("*").over(Window.partitionBy("aircraft_id"))}).where("rank = 1")
    gap = F.floor((F.unix_seconds("start_time") - F.unix_seconds("previous")) / 86400)
    label = F.when(F.col("n") == 1, "new").when(gap >= returning_days, "returning").when(F.col("n") <= rare, "rare").otherwise("regular")
    return latest.select("aircraft_id", "flight_id", F.col("n").alias("flights"), gap.alias("gap_days"), label.alias("label"))


def airport_traffic(flights: DataFrame) -> DataFrame:
    """Arrivals, departures, aircraft and loops of every airport; a loop flight counts once as a movement."""
    ends = flights.select("flight_id", "aircraft_id", F.explode(F.array(F.struct(F.col("origin").alias("airport"), F.lit(1).alias("out")), F.struct(F.col("destination").alias("airport"), F.lit(0).alias("out")))).alias("e")).select("flight_id", "aircraft_id", "e.*")
    return ends.where("airport IS NOT NULL").groupBy("airport").agg(F.count_if(F.col("out") == 0).alias("arrivals"), F.count_if(F.col("out") == 1).alias("departures"), F.countDistinct("flight_id").alias("movements"), F.countDistinct("aircraft_id").alias("aircraft"))


def airport_heatmap(flights: DataFrame, airport: str, zone: str) -> DataFrame:
    """Movements by ISO weekday and local hour, all 7 x 24 cells."""
    spark = flights.sparkSession
    local = F.from_utc_timestamp("start_time", zone)
    counted = flights.where((F.col("origin") == airport) | (F.col("destination") == airport)).groupBy((F.weekday(local) + 1).cast("long").alias("weekday"), F.hour(local).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    spine = spark.range(7 * 24).select((F.floor(F.col("id") / 24) + 1).cast("long").alias("weekday"), (F.col("id") % 24).alias("hour"))
    return spine.join(counted, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("movements"))


def search(flights: DataFrame, term: str, k: int = 20) -> DataFrame:
    """Ranked search over callsign, origin and destination: exact, then prefix, then contained."""
    low = term.lower()
    parts = []
    for i, field in enumerate(("callsign", "origin", "destination")):
        value = F.lower(field)
        tier = F.when(value == low, 0).when(value.startswith(low), 1).when(value.contains(low), 2)
        parts.append(F.struct(tier.alias("tier"), F.lit(i).alias("field")))
    hits = F.array_sort(F.filter(F.array(*parts), lambda p: p["tier"].isNotNull()))
    return flights.withColumn("hit", F.get(hits, F.lit(0))).where("hit IS NOT NULL").select("flight_id", F.col("hit.tier").cast("long").alias("tier"), F.col("hit.field").cast("long").alias("field")).orderBy("tier", "field", "flight_id").limit(k)
