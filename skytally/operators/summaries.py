"""What a range of local days holds: rankings, and summaries of aircraft and airports.

Rankings are counted by name before anything is joined or sorted; of each key only the
first few names reach a window's sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .reports import in_range, local_bounds
from .traffic import country_label


def _name(column: str) -> Column:
    return F.upper(clean_text(F.col(column)))


def ranked(rows: DataFrame, keys: list[str], name: Column, k: int) -> DataFrame:
    """Of each key the k most frequent names: keys, name, n and rank, the most frequent first, then by name."""
    counted = rows.select(*keys, name.alias("name")).where("name IS NOT NULL").groupBy(*keys, "name").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "name")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _listed(top: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Rankings in one text a key: name:n, in order."""
    texts = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "name", "n").alias("text"))))
    return top.groupBy(*keys).agg(F.array_join(F.transform(texts, lambda t: t["text"]), ",").alias(out))


def range_rankings(flights: DataFrame, aircraft: DataFrame, names: list[str], now: str, zone: str, k: int = 8) -> DataFrame:
    """The most frequent types, airlines, operators, countries, origins, destinations and routes of flights that began in each range."""
    route = F.when(_name("origin").isNotNull() & _name("destination").isNotNull(), F.concat_ws("-", _name("origin"), _name("destination")))
    of_flight = {"type": _name("aircraft_type"), "airline": _name("airline"), "origin": _name("origin"), "destination": _name("destination"), "route": route}
    known = aircraft.select("aircraft_id", _name("operator").alias("operator"), country_label().alias("country"))
    parts = []
    for name in names:
        rows = in_range(flights, "start_time", name, now, zone)
        kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), c.alias("value")) for kind, c in of_flight.items())))
        mine = rows.select(kinds.alias("k")).select("k.*")
        # Flights are counted by aircraft before they meet its data.
        per = rows.groupBy("aircraft_id").agg(F.count("*").alias("times")).join(known, "aircraft_id")
        theirs = per.select("times", F.explode(F.array(F.struct(F.lit("operator").alias("kind"), F.col("operator").alias("value")), F.struct(F.lit("country").alias("kind"), F.col("country").alias("value")))).alias("k")).select("k.*", "times")
        counted = mine.withColumn("times", F.lit(1).cast("long")).unionByName(theirs).where("value IS NOT NULL").groupBy("kind", "value").agg(F.sum("times").alias("n"))
        order = Window.partitionBy("kind").orderBy(F.desc("n"), "value")
        parts.append(counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.lit(name).alias("range"), "kind", F.col("value").alias("name"), "n", F.col("rank").cast("long").alias("rank")))
    return reduce(DataFrame.unionByName, parts)


def _within(flights: DataFrame, days: int, now: str, zone: str) -> tuple[DataFrame, Column]:
    """Flights that began in the last local days, before ``now``, and when each was last seen, ``now`` at the latest."""
    first, last = local_bounds(flights.sparkSession, days - 1, now, zone)
    bound = lambda text: F.lit(text).cast(flights.schema["start_time"].dataType)
    return flights.where((F.col("start_time") >= bound(first)) & (F.col("start_time") < bound(last))), F.least(F.col("last_seen_at"), F.lit(last).cast("timestamp"))


def _active_days(rows: DataFrame, key: str, until: Column, zone: str) -> DataFrame:
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    days = rows.select(key, F.explode(F.sequence(local(F.col("start_time")), F.greatest(local(until), local(F.col("start_time"))))).alias("d")).distinct()
    return days.groupBy(key).agg(F.count("*").alias("active_days"))


def aircraft_ranges(flights: DataFrame, airports: DataFrame, days: int, now: str, zone: str, k: int = 5) -> DataFrame:
    """Each aircraft's last days: flights, active local days, first and last sight, its call signs, origins, destinations and routes.

    Only airports that the catalogue (icao) knows count as origins, destinations and ends of routes.
    """
    rows, until = _within(flights, days, now, zone)
    known = airports.select(F.col("icao").alias("_code")).distinct()
    ends = rows.withColumns({"_from": _name("origin"), "_to": _name("destination"), "_until": until, "_call": _name("callsign")})
    for end in ("_from", "_to"):
        ends = ends.join(known.withColumnRenamed("_code", f"{end}_known"), F.col(end) == F.col(f"{end}_known"), "left")
    route = F.when(F.col("_from_known").isNotNull() & F.col("_to_known").isNotNull(), F.concat_ws("-", "_from_known", "_to_known"))
    key = ["aircraft_id"]
    out = ends.groupBy(*key).agg(F.count("*").alias("flights"), F.unix_seconds(F.min("start_time")).alias("first_s"), F.unix_seconds(F.max("_until")).alias("last_s"))
    out = out.join(_active_days(ends, "aircraft_id", F.col("_until"), zone), "aircraft_id")
    for name, column, most in (("top_callsigns", F.col("_call"), k), ("top_origin", F.col("_from_known"), 1), ("top_destination", F.col("_to_known"), 1), ("top_routes", route, k)):
        out = out.join(_listed(ranked(ends, key, column, most), key, name), "aircraft_id", "left")
    return out


def airport_ranges(flights: DataFrame, days: int, now: str, zone: str, k: int = 5, recent: int = 10) -> DataFrame:
    """Each airport's last days: flights, arrivals, departures, aircraft, active local days, where they went and came from, call signs, the last flights.

    A flight from an airport to itself is one flight, an arrival and a departure.
    """
    rows, until = _within(flights, days, now, zone)
    ends = rows.withColumns({"_from": _name("origin"), "_to": _name("destination"), "_until": until, "_call": _name("callsign")})
    of = F.explode(F.array_distinct(F.array_compact(F.array("_from", "_to"))))
    ends = ends.withColumn("airport", of).withColumns({"out": F.coalesce(F.col("_from") == F.col("airport"), F.lit(False)), "in": F.coalesce(F.col("_to") == F.col("airport"), F.lit(False))})
    key = ["airport"]
    # One row an aircraft and airport first, then plain counts.
    per = ends.groupBy("airport", "aircraft_id").agg(F.count("*").alias("flights"), F.count_if("in").alias("arrivals"), F.count_if("out").alias("departures"))
    out = per.groupBy("airport").agg(F.sum("flights").alias("flights"), F.sum("arrivals").alias("arrivals"), F.sum("departures").alias("departures"), F.count("*").alias("aircraft"))
    out = out.join(_active_days(ends, "airport", F.col("_until"), zone), "airport")
    for name, column in (("top_destinations", F.when(F.col("out"), F.col("_to"))), ("top_origins", F.when(F.col("in"), F.col("_from"))), ("top_callsigns", F.col("_call"))):
        out = out.join(_listed(ranked(ends, key, column, k), key, name), "airport", "left")
    newest = Window.partitionBy("airport").orderBy(F.desc("start_time"), F.desc("flight_id"))
    last = ends.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= recent)
    ids = F.array_sort(F.collect_list(F.struct("rank", F.col("flight_id").cast("string").alias("text"))))
    return out.join(last.groupBy("airport").agg(F.array_join(F.transform(ids, lambda t: t["text"]), ",").alias("recent")), "airport")
