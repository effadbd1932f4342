"""Queries whose rows depend on what was decided before, with recursive SQL beside them.

The test reports are some hours apart, so limits are wider than an operator would set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds, integrity, reports
from ..sources.testdata import CALLS, OBSERVATIONS, Frames
from .base import ORACLES, query
from .chains import STATES
from . import reports as _reports  # noqa: F401, I001
from .matching import _hav, _turn

#: The first common table that is given, so that later ones may be recursive.
_OBS = OBSERVATIONS.replace("obs0 AS", "RECURSIVE obs0 AS", 1)


def _walk(state: str, keep: str, rows: str = "obs", key: str = "icao_hex") -> str:
    """Tables ``k`` (rows with ``s``, what is remembered of each) and ``w`` (with ``kept``): each row against the last kept one, ``st``."""
    keys = [f"k.{c.strip()} = w.{c.strip()}" for c in key.split(",")]
    return f"""
k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY observed_at, event_id) AS i, {state} AS s FROM {rows}),
w AS (SELECT {key}, i, event_id, s AS st, true AS kept FROM k WHERE i = 1
  UNION ALL SELECT {key}, i, event_id, CASE WHEN g THEN s ELSE st END, g FROM (SELECT k.*, w.st, coalesce({keep}, false) AS g FROM w JOIN k ON {' AND '.join(keys)} AND k.i = w.i + 1) z)"""


_PLACE = "{'t': epoch_us(observed_at), 'y': lat, 'x': lon}"
_AGO = "((epoch_us(k.observed_at) - w.st.t) / 1000000)"
_FAR = _hav("w.st.y", "w.st.x", "k.lat", "k.lon")
_PLAUSIBLE = f"{_AGO} > 0 AND {_FAR} <= 0.02e0 * {_AGO}"
_CREDIBLE = f"{_AGO} <= 0 OR {_FAR} <= greatest(25, 900 * 1.852e0 * 1.5 / 3600 * {_AGO})"


@query(f", {_walk(_PLACE, _PLAUSIBLE)} SELECT event_id FROM w WHERE kept", (_OBS,))
def plausible_trail(x: Frames) -> DataFrame:
    """At 20 metres a second."""
    return folds.plausible_positions(x.observations().select("event_id", "icao_hex", "observed_at", "lat", "lon"), ["icao_hex"], km_per_s=0.02).where("kept").select("event_id")


@query(f", {_walk(_PLACE, _CREDIBLE)} SELECT event_id, kept AS credible FROM w", (_OBS,))
def live_plausibility(x: Frames) -> DataFrame:
    """Whether a position is within what its aircraft can fly from the last credible one."""
    rows = folds.credible_positions(x.observations().select("event_id", "icao_hex", "observed_at", "lat", "lon"), ["icao_hex"])
    return rows.select("event_id", F.col("kept").alias("credible"))


@query(f", {_walk(_PLACE, f'{_AGO} >= 7200')} SELECT event_id FROM w WHERE kept", (_OBS,))
def history_sampling(x: Frames) -> DataFrame:
    """One report in two hours at most."""
    return folds.sampled(x.observations().select("event_id", "icao_hex", "observed_at"), ["icao_hex"], seconds=7200).where("kept").select("event_id")


@query(f", {_walk(_PLACE[:-1] + ', ' + repr('source') + ': source, ' + repr('state') + ': state}', f'abs(k.lat - w.st.y) >= 1.2 OR abs(k.lon - w.st.x) >= 1.2 OR k.source <> w.st.source OR k.state <> w.st.state OR {_AGO} >= 86400', 'cell', 'icao_hex, band')} SELECT event_id FROM w WHERE kept", (_OBS, STATES))
def integrity_heartbeats(x: Frames) -> DataFrame:
    """With a day and 1.2 degrees."""
    rows = integrity.celled(x.signals()).select("event_id", "icao_hex", "band", "observed_at", "lat", "lon", "source", "state")
    return folds.changed(rows, ["icao_hex", "band"], degrees=1.2, heartbeat_s=86_400).where("kept").select("event_id")


#: Reports of which some repeat: the same place some times in a row, and one time and place twice.
_STAYS = "SELECT event_id, icao_hex, observed_at, CASE WHEN event_id % 3 = 0 THEN 50e0 ELSE lat END AS lat, CASE WHEN event_id % 3 = 0 THEN 15e0 ELSE lon END AS lon FROM obs UNION ALL SELECT event_id + 10000000, icao_hex, observed_at, CASE WHEN event_id % 3 = 0 THEN 50e0 ELSE lat END, CASE WHEN event_id % 3 = 0 THEN 15e0 ELSE lon END FROM obs WHERE event_id % 10 = 0"


@query(f"""
, stays AS ({_STAYS}), u AS (SELECT * FROM stays QUALIFY row_number() OVER (PARTITION BY icao_hex, observed_at, lat, lon ORDER BY event_id DESC) = 1),
v AS (SELECT *, lead(lat) OVER o AS ny, lead(lon) OVER o AS nx FROM u WINDOW o AS (PARTITION BY icao_hex ORDER BY observed_at, event_id)),
d AS (SELECT * EXCLUDE (ny, nx) FROM v WHERE NOT coalesce(abs(ny - lat) <= 1e-5 AND abs(nx - lon) <= 1e-5, false)),
{_walk(_PLACE, _PLAUSIBLE, 'd').strip()},
p AS (SELECT d.* FROM w JOIN d USING (event_id) WHERE kept)
SELECT event_id, icao_hex, observed_at, lat, lon FROM p QUALIFY epoch_us(max(observed_at) OVER (PARTITION BY icao_hex)) - epoch_us(observed_at) <= 1728000000000 AND row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at DESC, event_id DESC) <= 12""", (_OBS,))
def bounded_trail(x: Frames) -> DataFrame:
    """Twelve positions of twenty days at most, at 20 metres a second."""
    rows = x.made(_STAYS, obs=x.observations())
    return folds.bounded_trail(rows, "icao_hex", km_per_s=0.02, most=12, max_age_s=20 * 86_400)


#: Credible positions only make a flight; what is rejected starts and extends none.
_SESSIONS = ORACLES["flight_sessions_exact"].split("calls AS (", 1)[1].split("), g AS", 1)[1].replace("k AS (", "named AS (").replace("FROM k)", "FROM named)")


@query(f", {_walk(_PLACE, _PLAUSIBLE)}, good AS (SELECT obs.* FROM obs JOIN w USING (event_id) WHERE kept), calls AS ({CALLS.replace('FROM obs', 'FROM good')}), g AS{_SESSIONS}", (_OBS,))
def flight_sessions_credible(x: Frames) -> DataFrame:
    """Flights of positions that can follow the last one that was taken, at 20 metres a second, with gaps of ten hours."""
    obs = x.observations()
    good = folds.plausible_positions(obs.select("event_id", "icao_hex", "observed_at", "lat", "lon"), ["icao_hex"], km_per_s=0.02).where("kept").select("event_id")
    return reports.sessions(x.calls().join(good, "event_id", "left_semi"), minutes=600)


#: Weather that changes from one half day to the next.
_WEATHER = """
SELECT event_id, icao_hex, observed_at, h % 2 + 49e0 AS lat, 15e0 AS lon, h % 3 * 700 + CASE WHEN event_id % 6 = 0 THEN 100 ELSE 0 END AS altitude_ft, CAST(h * 10 % 360 AS DOUBLE) AS wind_from,
  CASE WHEN event_id % 9 > 0 THEN h % 4 * 3 END AS wind_kt, CASE WHEN event_id % 8 > 0 THEN h % 5 / 2e0 END AS temperature_c,
  CASE WHEN event_id % 4 = 0 THEN 'BDS_4_4' WHEN event_id % 7 = 0 THEN 'MRAR' ELSE 'READSB' END AS source, CASE WHEN event_id % 10 = 0 THEN 'network' ELSE 'local' END AS provider,
  CASE WHEN event_id % 11 = 0 THEN 'REJECTED' WHEN event_id % 5 = 0 THEN 'HIGH' WHEN event_id % 13 = 0 THEN 'DEGRADED' ELSE 'GOOD' END AS quality
FROM half"""
_HALF = "half AS (SELECT *, epoch_us(observed_at) // 43200000000 AS h FROM obs)"
_M = ("lat", "lon", "altitude_ft", "wind_from", "wind_kt", "temperature_c", "source", "provider")
_WAS = "{" + ", ".join(f"'{c}': {c}" for c in (*_M, "quality")) + ", 't': epoch_us(observed_at)}"


def _alters(c: str, least: float) -> str:
    step = f"abs({_turn(f'k.{c}', f'w.st.{c}')})" if c == "wind_from" else f"abs(k.{c} - w.st.{c})"
    return f"((k.{c} IS NULL) <> (w.st.{c} IS NULL) OR coalesce({step} >= {least}, false))"


_WHY = f"""CASE WHEN w.st IS NULL THEN 'FIRST_OBSERVATION' WHEN k.source = 'BDS_4_4' AND {' AND '.join(f'k.{c} IS NOT DISTINCT FROM w.st.{c}' for c in _M)} AND abs({_AGO}) <= 7200 THEN NULL WHEN k.source = 'BDS_4_4' THEN 'BDS44_UNIQUE'
  WHEN k.source <> w.st.source OR k.provider <> w.st.provider THEN 'SOURCE_CHANGE' WHEN k.quality <> w.st.quality AND NOT (w.st.quality = 'HIGH' AND k.quality = 'GOOD') THEN 'QUALITY_CHANGE' WHEN floor(k.altitude_ft / 1000) <> floor(w.st.altitude_ft / 1000) THEN 'ALTITUDE_BIN_CHANGE'
  WHEN {' OR '.join(_alters(c, v) for c, v in folds.WEATHER_CHANGE.items())} THEN 'WEATHER_CHANGE' WHEN {_AGO} >= 86400 THEN 'HEARTBEAT' END"""


@query(f"""
, {_HALF}, weather AS ({_WEATHER}), k AS (SELECT *, row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) AS i, {_WAS} AS s FROM weather WHERE quality <> 'REJECTED'),
w AS (SELECT icao_hex, i, event_id, s AS st, 'FIRST_OBSERVATION' AS reason FROM k WHERE i = 1
  UNION ALL SELECT icao_hex, i, event_id, CASE WHEN r IS NOT NULL THEN s ELSE st END, r FROM (SELECT k.*, w.st, {_WHY} AS r FROM w JOIN k ON k.icao_hex = w.icao_hex AND k.i = w.i + 1) z)
SELECT event_id, reason FROM weather LEFT JOIN w USING (event_id)""", (_OBS,))
def weather_persistence(x: Frames) -> DataFrame:
    """A heartbeat a day, and two hours that tell duplicates."""
    half = x.observations().withColumn("h", F.floor(F.unix_micros("observed_at") / 43_200_000_000))
    return folds.weather_persistence(x.made(_WEATHER, half=half), heartbeat_s=86_400, duplicate_s=7200).select("event_id", "reason")


#: What the sources say of an altitude, and how old each is.
_ALTITUDES = """
SELECT event_id, icao_hex, observed_at, CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 29 = 0 THEN 126000 ELSE 10000 + event_id % 90 * 100 END END AS beast_ft, event_id % 40 AS beast_age,
  CASE WHEN event_id % 5 > 1 THEN 10000 + event_id % 70 * 150 END AS json_ft, event_id % 35 AS json_age, CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 31 = 0 THEN 40000 ELSE 12000 END END AS net_ft,
  CASE WHEN event_id % 6 > 0 THEN event_id % 45 END AS net_age, CASE event_id % 8 WHEN 0 THEN 'MLAT' WHEN 1 THEN 'TIS_B' WHEN 2 THEN 'OTHER' ELSE 'NETWORK' END AS net_source
FROM obs"""
_V = {n: f"({n}_ft IS NOT NULL AND coalesce({n}_age, 0) <= 30)" for n in ("beast", "json", "net")}
_PICK = lambda f: f"CASE WHEN {_V['beast']} THEN {f('beast')} WHEN {_V['json']} THEN {f('json')} WHEN {_V['net']} THEN {f('net')} END"
_SRC = {"beast": "'LOCAL_BEAST'", "json": "'READSB_JSON'", "net": "net_source"}


@query(f"""
, alt AS ({_ALTITUDES}), f AS (SELECT *, {_PICK(lambda n: f"'{n}'")} AS one, {_PICK(lambda n: f'{n}_ft')} AS ft FROM alt),
d AS (SELECT *, coalesce({' OR '.join(f"({v} AND one <> '{n}' AND abs({n}_ft - ft) > 12000)" for n, v in _V.items())}, false) AS apart FROM f),
e AS (SELECT *, CASE WHEN apart AND one = 'beast' AND ft > 80000 THEN CASE WHEN {_V['json']} AND json_ft <= 80000 THEN 'json' WHEN {_V['net']} AND net_ft <= 80000 THEN 'net' ELSE one END ELSE one END AS pick FROM d),
c AS (SELECT event_id, icao_hex, observed_at, apart, CASE pick {' '.join(f"WHEN '{n}' THEN {s}" for n, s in _SRC.items())} END AS src, CASE pick {' '.join(f"WHEN '{n}' THEN {n}_ft" for n in _SRC)} END AS ft,
  epoch_us(observed_at) - coalesce(CASE pick {' '.join(f"WHEN '{n}' THEN {n}_age" for n in _SRC)} END, 0) * 1000000 AS us FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY icao_hex ORDER BY observed_at, event_id) AS i, {{'src': src, 'ft': ft, 'us': us}} AS s FROM c),
w AS (SELECT icao_hex, i, event_id, CASE WHEN src IS NOT NULL THEN s END AS st, false AS jump FROM k WHERE i = 1
  UNION ALL SELECT icao_hex, i, event_id, CASE WHEN g OR src IS NULL THEN st ELSE s END, g FROM (SELECT k.*, w.st,
    coalesce(k.us <> w.st.us AND k.src = w.st.src AND (k.us - w.st.us) / 1e6 >= 2 AND (k.us - w.st.us) / 1e6 < 604800 AND abs(k.ft - w.st.ft) > 0.02e0 / 60 * ((k.us - w.st.us) / 1e6), false) AS g FROM w JOIN k ON k.icao_hex = w.icao_hex AND k.i = w.i + 1) z)
SELECT event_id, CASE WHEN jump THEN st.src ELSE src END AS selected_source, CAST(CASE WHEN jump THEN st.ft ELSE ft END AS DOUBLE) AS selected_ft,
  CASE WHEN jump THEN 'IMPLAUSIBLE_JUMP_REJECTED' WHEN src IS NULL THEN 'INVALID_VALUE_REJECTED' WHEN src = 'LOCAL_BEAST' THEN 'LOCAL_BEAST_FRESH_PRIORITY' WHEN src = 'READSB_JSON' THEN 'READSB_JSON_FRESH_PRIORITY' WHEN src IN ('NETWORK', 'MLAT', 'TIS_B') THEN 'NETWORK_FALLBACK' ELSE 'OTHER_FALLBACK' END AS reason,
  CASE WHEN jump THEN 'IMPLAUSIBLE_JUMP' WHEN apart THEN 'DISAGREEMENT' END AS anomaly FROM w JOIN k USING (icao_hex, i, event_id)""", (_OBS,))
def altitude_arbitration(x: Frames) -> DataFrame:
    """With a rate of 0.02 feet a minute over a week."""
    one = lambda n, source: F.struct(source.alias("source"), F.col(f"{n}_ft").cast("double").alias("altitude_ft"), F.col(f"{n}_age").cast("double").alias("age_s"))
    rows = x.made(_ALTITUDES, obs=x.observations()).withColumn("candidates", F.array(one("net", F.col("net_source")), one("json", F.lit("READSB_JSON")), one("beast", F.lit("LOCAL_BEAST"))))
    decided = folds.altitude_arbitration(rows.select("event_id", "icao_hex", "observed_at", "candidates"), most_ft_min=0.02, long_gap_s=604_800)
    return decided.select("event_id", "selected_source", "selected_ft", "reason", "anomaly")


#: Frames of seven receivers: some without a counter, some with a wrong one, and clocks that run ahead.
_FRAMES = """
SELECT event_id, 'R' || event_id % 7 AS receiver, observed_at AS received_at, observed_at,
  CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 97 = 0 THEN event_id * 7919 % 1000000 WHEN event_id % 53 > 0 THEN (us * (12 + event_id % 7 % 3) + 190000000000000) % 281474976710656 END AS ticks
FROM timed"""


@query(f"""
, timed AS (SELECT *, epoch_us(observed_at) AS us FROM obs), f AS ({_FRAMES}), l AS (SELECT *, lag(ticks) OVER (PARTITION BY receiver ORDER BY observed_at, event_id) AS p FROM f WHERE ticks <> 0),
t AS (SELECT *, CASE WHEN ticks >= p THEN ticks - p WHEN p - ticks > 140737488355328 THEN ticks + 281474976710656 - p END AS st, epoch_us(observed_at) / 1000 AS ms FROM l),
k AS (SELECT *, coalesce(st <= 17592186044416, false) AS fine, sum(CASE WHEN coalesce(st <= 17592186044416, false) THEN st ELSE 0 END) OVER (PARTITION BY receiver ORDER BY observed_at, event_id) AS total, row_number() OVER (PARTITION BY receiver ORDER BY observed_at, event_id) AS i FROM t),
w AS (SELECT receiver, i, event_id, ms AS b, total AS bt, ms AS observed_ms, 'first' AS clock FROM k WHERE i = 1
  UNION ALL SELECT receiver, i, event_id, CASE WHEN how = 'counted' THEN b ELSE ms END, CASE WHEN how = 'counted' THEN bt ELSE total END, CASE WHEN how = 'counted' THEN b + CAST(total - bt AS BIGINT) / 12000 ELSE ms END, how
  FROM (SELECT k.*, w.b, w.bt, CASE WHEN NOT fine THEN 'break' WHEN abs(w.b + CAST(total - w.bt AS BIGINT) / 12000 - ms) > 86400000 THEN 'drift' ELSE 'counted' END AS how FROM w JOIN k ON k.receiver = w.receiver AND k.i = w.i + 1) z)
SELECT event_id, receiver, CAST(floor(observed_ms) AS BIGINT) AS observed_ms, clock FROM w UNION ALL SELECT event_id, receiver, CAST(floor(epoch_us(observed_at) / 1000) AS BIGINT), 'none' FROM f WHERE coalesce(ticks, 0) = 0""", (_OBS,))
def receiver_clock(x: Frames) -> DataFrame:
    timed = x.observations().withColumn("us", F.unix_micros("observed_at"))
    return folds.receiver_clock(x.made(_FRAMES, timed=timed).drop("observed_at")).select("event_id", "receiver", "observed_ms", "clock")
