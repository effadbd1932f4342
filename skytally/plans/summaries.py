"""Rankings and summaries over ranges of local days, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import summaries
from ..sources.testdata import FLIGHTS, ZONE, Frames
from .base import query

NOW = "1995-06-15 12:00:00"
#: The local midnights that the ranges begin at.
_FROM = {"today": "1995-06-14 22:00:00", "yesterday": "1995-06-13 22:00:00", "7d": "1995-06-08 22:00:00", "30d": "1995-05-16 22:00:00"}
_DAYS = {"7d": 7, "30d": 30}
_LOCAL = "CAST(({} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague' AS DATE)"


def _kinds(name: str) -> str:
    until = f"start_time < TIMESTAMP '{_FROM['today']}'" if name == "yesterday" else f"start_time <= TIMESTAMP '{NOW}'"
    values = {"type": "upper(trim(aircraft_type))", "airline": "upper(trim(airline))", "origin": "origin", "destination": "destination", "route": "origin || '-' || destination", "operator": "upper(operator)", "country": "CASE WHEN upper(country) = country_code THEN country ELSE country_code || ' · ' || country END"}
    return " UNION ALL ".join(f"SELECT '{name}' AS range, '{kind}' AS kind, {value} AS name FROM fl JOIN air USING (aircraft_id) WHERE start_time >= TIMESTAMP '{_FROM[name]}' AND {until}" for kind, value in values.items())


@query(f", k AS ({' UNION ALL '.join(map(_kinds, _FROM))}), c AS (SELECT range, kind, name, count(*) AS n FROM k WHERE name IS NOT NULL GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY range, kind ORDER BY n DESC, name) AS rank FROM c QUALIFY rank <= 8", (FLIGHTS,))
def traffic_range_rankings(x: Frames) -> DataFrame:
    return summaries.range_rankings(x.flights(), x.aircraft(), list(_FROM), NOW, ZONE)


def _top(table: str, key: str, value: str, k: int, out: str) -> str:
    return f"{out} AS (SELECT range, {key}, string_agg(v || ':' || n, ',' ORDER BY n DESC, v) AS {out} FROM (SELECT range, {key}, {value} AS v, count(*) AS n FROM {table} WHERE ({value}) IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY range, {key} ORDER BY n DESC, v) <= {k}) GROUP BY 1, 2)"


_ROWS = " UNION ALL ".join(f"SELECT '{r}' AS range, *, least(last_seen_at, TIMESTAMP '{NOW}') AS until FROM fl WHERE start_time >= TIMESTAMP '{_FROM[r]}' AND start_time < TIMESTAMP '{NOW}'" for r in _DAYS)


def _active(table: str, key: str) -> str:
    first, last = _LOCAL.format("start_time"), _LOCAL.format("until")
    return f"act AS (SELECT range, {key}, count(DISTINCT d) AS active_days FROM (SELECT range, {key}, unnest(generate_series({first}, greatest({first}, {last}), INTERVAL 1 DAY)) AS d FROM {table}) GROUP BY 1, 2)"


_TOPS = {"top_callsigns": ("callsign", 5), "top_origin": ("origin", 1), "top_destination": ("destination", 1), "top_routes": ("origin || '-' || destination", 5)}


@query(f"""
, r AS ({_ROWS}), {_active('r', 'aircraft_id')}, {', '.join(_top('r', 'aircraft_id', v, k, n) for n, (v, k) in _TOPS.items())},
s AS (SELECT range, aircraft_id, count(*) AS flights, CAST(epoch(min(start_time)) AS BIGINT) AS first_s, CAST(epoch(max(until)) AS BIGINT) AS last_s FROM r GROUP BY 1, 2)
SELECT s.*, active_days, {', '.join(_TOPS)} FROM s JOIN act USING (range, aircraft_id) {' '.join(f'LEFT JOIN {n} USING (range, aircraft_id)' for n in _TOPS)}""", (FLIGHTS,))
def aircraft_range_summary(x: Frames) -> DataFrame:
    part = lambda name, days: summaries.aircraft_ranges(x.flights(), x.airports(), days, NOW, ZONE).withColumn("range", F.lit(name))
    return reduce(DataFrame.unionByName, (part(*r) for r in _DAYS.items()))


_ENDS = {"top_destinations": "CASE WHEN origin = airport THEN destination END", "top_origins": "CASE WHEN destination = airport THEN origin END", "top_callsigns": "callsign"}


@query(f"""
, r AS ({_ROWS}), e AS (SELECT *, origin AS airport FROM r UNION ALL SELECT *, destination FROM r WHERE destination <> origin), {_active('e', 'airport')}, {', '.join(_top('e', 'airport', v, 5, n) for n, v in _ENDS.items())},
s AS (SELECT range, airport, count(*) AS flights, count(*) FILTER (destination = airport) AS arrivals, count(*) FILTER (origin = airport) AS departures, count(DISTINCT aircraft_id) AS aircraft FROM e GROUP BY 1, 2),
l AS (SELECT range, airport, string_agg(CAST(flight_id AS VARCHAR), ',' ORDER BY start_time DESC, flight_id DESC) AS recent FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY range, airport ORDER BY start_time DESC, flight_id DESC) <= 10) GROUP BY 1, 2)
SELECT s.*, active_days, {', '.join(_ENDS)}, recent FROM s JOIN act USING (range, airport) JOIN l USING (range, airport) {' '.join(f'LEFT JOIN {n} USING (range, airport)' for n in _ENDS)}""", (FLIGHTS,))
def airport_range_report(x: Frames) -> DataFrame:
    part = lambda name, days: summaries.airport_ranges(x.flights(), days, NOW, ZONE).withColumn("range", F.lit(name))
    return reduce(DataFrame.unionByName, (part(*r) for r in _DAYS.items()))
