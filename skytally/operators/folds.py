"""Decisions that depend on what was decided before, as folds in column functions.

Whether a row is accepted may depend on the last one that was. What follows a gap of
``restart_s`` is accepted whatever came before (that is how the bound is chosen), so a
key's rows fall into chains at such gaps (session windows), and a fold runs over each
chain by itself: over sorted arrays, in the JVM, with the state of the last decision
carried along. An aircraft that lands or leaves ends its chain.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import Steps
from .scans import carried, following, last_known, previous, running_sum

#: Elements that are folded into one array; appending copies what is there.
RUN = 128
HALF_ROUND_KM = math.pi * geo.EARTH_KM


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(items: Column, state: str, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The last state and the outputs, in order, of ``step(state, item) -> (state, output)`` over an array; the state is null at first."""
    nothing = lambda kind: F.array().cast(f"array<{kind}>")

    def inner(acc: Column, item: Column) -> Column:
        after, result = step(acc["state"], item)
        return let(F.struct(after.cast(state).alias("state"), result.cast(out).alias("out")), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], F.array(s["out"])).alias("out")))

    def outer(acc: Column, begin: Column) -> Column:
        run = F.aggregate(F.slice(items, begin, F.lit(RUN)), F.struct(acc["state"].alias("state"), nothing(out).alias("out")), inner)
        return let(run, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    begins = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(RUN))
    start = F.struct(F.lit(None).cast(state).alias("state"), nothing(f"array<{out}>").alias("out"))
    return F.aggregate(begins, start, outer, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))


def by_chain(
    rows: DataFrame, keys: list[str], at: str, tie: str, restart_s: float, state: str, out: str,
    step: Callable[[Column, Column], tuple[Column, Column]], first: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``rows`` with ``decision``, the output of a fold over each chain in order of ``at`` and then of ``tie``, and ``chain``, the time it begins.

    ``first(last state of the chains before, row)`` is the output for the first row of a
    chain, where that depends on them though what is accepted does not.
    """
    others = [c for c in rows.columns if c not in (at, tie, *keys)]
    gap = F.session_window(at, f"{round(restart_s * 1_000_000)} microseconds")
    chains = rows.groupBy(*keys, gap.alias("_w")).agg(F.sort_array(F.collect_list(F.struct(at, tie, *others))).alias("_rows"))
    chains = chains.select(*keys, F.col("_w.start").alias("chain"), "_rows", fold(F.col("_rows"), state, out, step).alias("_f"))
    outs = F.col("_f.out")
    if first is not None:
        earlier = Window.partitionBy(*keys).orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)
        chains = chains.withColumn("_before", F.last("_f.state", ignorenulls=True).over(earlier))
        again = first(F.col("_before"), F.element_at("_rows", 1)).cast(out)
        outs = F.concat(F.array(again), F.slice(outs, F.lit(2), F.greatest(F.size(outs), F.lit(1))))
    decided = chains.select(*keys, "chain", F.explode(F.arrays_zip(F.col("_rows").alias("row"), outs.alias("decision"))).alias("_d"))
    return decided.select(*keys, "chain", "_d.row.*", "_d.decision").select(*rows.columns, "chain", "decision")


def _fields(rows: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"{n}:{rows.schema[n].dataType.simpleString()}" for n in names) + ">"


def greedy(rows: DataFrame, keys: list[str], at: str, tie: str, restart_s: float, fields: list[str], keep: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with ``kept``: whether a row is the first of its chain, or ``keep(last kept one, row)``; null counts as not."""

    def step(last: Column, row: Column) -> tuple[Column, Column]:
        good = last.isNull() | F.coalesce(keep(last, row), F.lit(False))
        # The test stands in an array of one, so that it is made once for both.
        both = let(good, lambda g: F.struct(F.when(g, F.struct(*(row[f].alias(f) for f in fields))).otherwise(last).alias("last"), g.alias("kept")))
        return both["last"], both["kept"]

    return by_chain(rows, keys, at, tie, restart_s, _fields(rows, fields), "boolean", step).drop("chain").withColumnRenamed("decision", "kept")


def _seconds(last: Column, row: Column, at: str) -> Column:
    return (F.unix_micros(row[at].cast("timestamp")) - F.unix_micros(last[at].cast("timestamp"))) / 1_000_000


def _km(last: Column, row: Column) -> Column:
    return geo.haversine_km(last["lat"], last["lon"], row["lat"], row["lon"])


def plausible_positions(rows: DataFrame, keys: list[str], at: str = "observed_at", tie: str = "event_id", km_per_s: float = 0.45) -> DataFrame:
    """``kept``: later than the last kept position of the key, and no faster from there than any aircraft flies.

    After the time that half way round the world takes, any position can be reached.
    """

    def keep(last: Column, row: Column) -> Column:
        seconds = _seconds(last, row, at)
        return (seconds > 0) & (_km(last, row) <= km_per_s * seconds)

    return greedy(rows, keys, at, tie, HALF_ROUND_KM / km_per_s + 1, [at, "lat", "lon"], keep)


def credible_positions(rows: DataFrame, keys: list[str], at: str = "observed_at", tie: str = "event_id", floor_km: float = 25, knots: float = 900, slack: float = 1.5) -> DataFrame:
    """``kept``: within ``floor_km`` of the last credible position, or what ``knots`` with some slack reach; an equal time says nothing against it."""
    km_per_s = knots * 1.852 * slack / 3600

    def keep(last: Column, row: Column) -> Column:
        seconds = _seconds(last, row, at)
        return (seconds <= 0) | (_km(last, row) <= F.greatest(F.lit(float(floor_km)), km_per_s * seconds))

    return greedy(rows, keys, at, tie, HALF_ROUND_KM / km_per_s + 1, [at, "lat", "lon"], keep)


def sampled(rows: DataFrame, keys: list[str], at: str = "observed_at", tie: str = "event_id", seconds: float = 20.0) -> DataFrame:
    """``kept``: ``seconds`` or more after the last kept row."""
    return greedy(rows, keys, at, tie, seconds, [at], lambda last, row: _seconds(last, row, at) >= seconds)


def changed(rows: DataFrame, keys: list[str], at: str = "observed_at", tie: str = "event_id", degrees: float = 0.1, heartbeat_s: float = 120.0) -> DataFrame:
    """``kept``: an integrity observation with another source or state than the last kept one, a move, or time enough in between."""

    def keep(last: Column, row: Column) -> Column:
        moved = (F.abs(row["lat"] - last["lat"]) >= degrees) | (F.abs(row["lon"] - last["lon"]) >= degrees)
        return moved | (row["source"] != last["source"]) | (row["state"] != last["state"]) | (_seconds(last, row, at) >= heartbeat_s)

    return greedy(rows, keys, at, tie, heartbeat_s, [at, "lat", "lon", "source", "state"], keep)


def bounded_trail(rows: DataFrame, key: str, at: str = "observed_at", tie: str = "event_id", km_per_s: float = 0.45, most: int = 600, max_age_s: int = 1800) -> DataFrame:
    """The trail of each aircraft: its last plausible positions, ``most`` of them and none older than ``max_age_s`` before the newest.

    Of rows of equal time and place the last counts; a position that is followed by one
    within 1e-5 degrees gives way to it.
    """
    same = [key, at, "lat", "lon"]
    others = [c for c in rows.columns if c not in same]
    unique = rows.groupBy(*same).agg(F.max(F.struct(tie, *(c for c in others if c != tie))).alias("_r")).select(*same, "_r.*").select(*rows.columns)
    # Each table that is written is read twice by what follows.
    step = Steps()
    after = carried(step(unique), [key], at, tie, _next=following(F.struct("lat", "lon")))
    stays = F.coalesce((F.abs(F.col("_next.lat") - F.col("lat")) <= 1e-5) & (F.abs(F.col("_next.lon") - F.col("lon")) <= 1e-5), F.lit(False))
    trail = step(plausible_positions(after.where(~stays).drop("_next"), [key], at, tie, km_per_s).where("kept").drop("kept"))
    newest = trail.groupBy(key).agg(F.max(at).alias("_newest"))
    recent = trail.join(newest, key).where(F.unix_micros(F.col("_newest").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) <= max_age_s * 1_000_000)
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    return recent.withColumn("_back", back).where(F.col("_back") <= most).select(*rows.columns)


#: How much each weather field has to change to be worth a row (fixed values).
WEATHER_CHANGE = {"temperature_c": 1.0, "wind_kt": 5.0, "wind_from": 15.0}
_MEASURED = ["lat", "lon", "altitude_ft", "wind_from", "wind_kt", "temperature_c"]


def _altered(last: Column, row: Column, field: str, least: float) -> Column:
    """Whether a field appeared, went missing or moved by ``least``; directions go round."""
    step = F.abs(row[field] - last[field])
    step = F.least(step, 360 - step) if field == "wind_from" else step
    return (row[field].isNull() != last[field].isNull()) | F.coalesce(step >= least, F.lit(False))


def weather_reason(last: Column, row: Column, at: str, heartbeat_s: float, bin_ft: int, duplicate_s: float) -> Column:
    """Why a weather observation that is not rejected is stored, given the last stored one (null: none); null if it is not."""
    elapsed = _seconds(last, row, at)
    equal = lambda c: row[c].eqNullSafe(last[c])
    same = equal(_MEASURED[0])
    for c in [*_MEASURED[1:], "source", "provider"]:
        same = same & equal(c)
    altered = F.lit(False)
    for c, least in WEATHER_CHANGE.items():
        altered = altered | _altered(last, row, c, least)
    quality = (last["quality"] != row["quality"]) & ~((last["quality"] == "HIGH") & (row["quality"] == "GOOD"))
    register = row["source"] == "BDS_4_4"
    return (
        F.when(last.isNull(), "FIRST_OBSERVATION").when(register & same & (F.abs(elapsed) <= duplicate_s), F.lit(None)).when(register, "BDS44_UNIQUE")
        .when(~equal("source") | ~equal("provider"), "SOURCE_CHANGE").when(quality, "QUALITY_CHANGE")
        .when(F.floor(last["altitude_ft"] / bin_ft) != F.floor(row["altitude_ft"] / bin_ft), "ALTITUDE_BIN_CHANGE")
        .when(altered, "WEATHER_CHANGE").when(elapsed >= heartbeat_s, "HEARTBEAT")
    )


def weather_persistence(rows: DataFrame, key: str = "icao_hex", at: str = "observed_at", tie: str = "event_id", heartbeat_s: float = 120, bin_ft: int = 1000, duplicate_s: float = 15) -> DataFrame:
    """``rows`` (quality, source, provider and measured fields) with ``reason``: why each is stored, null if it is not.

    Rejected rows are never stored and change nothing. What comes a heartbeat after the row
    before is stored in any case, so chains end there; the reason of a chain's first row is
    found from the last row that was stored in a chain before.
    """
    if heartbeat_s <= duplicate_s:
        raise ValueError("a heartbeat is longer than the time that tells duplicates")
    fields = [at, *_MEASURED, "quality", "source", "provider"]
    told = lambda last, row: weather_reason(last, row, at, heartbeat_s, bin_ft, duplicate_s)

    def step(last: Column, row: Column) -> tuple[Column, Column]:
        both = let(F.struct(told(last, row).alias("r")), lambda r: F.struct(F.when(r["r"].isNotNull(), F.struct(*(row[f].alias(f) for f in fields))).otherwise(last).alias("last"), r["r"].alias("reason")))
        return both["last"], both["reason"]

    accepted, rejected = rows.where("quality <> 'REJECTED'"), rows.where("quality = 'REJECTED'")
    decided = by_chain(accepted, [key], at, tie, heartbeat_s, _fields(rows, fields), "string", step, told).drop("chain").withColumnRenamed("decision", "reason")
    return decided.unionByName(rejected.withColumn("reason", F.lit(None).cast("string")))


#: Order in which sources of altitude count (fixed values).
ALTITUDE_SOURCES = ("LOCAL_BEAST", "READSB_JSON", "NETWORK", "MLAT", "TIS_B", "OTHER", "UNKNOWN")


def altitude_arbitration(
    rows: DataFrame, key: str = "icao_hex", at: str = "observed_at", tie: str = "event_id", fresh_s: float = 30, disagreement_ft: int = 12_000,
    envelope_ft: int = 80_000, most_ft_min: float = 24_000, long_gap_s: float = 300, least_gap_s: float = 2,
) -> DataFrame:
    """``rows`` with an array ``candidates`` of (source, altitude_ft, age_s): ``selected_source``, ``selected_ft``, ``reason`` and ``anomaly``.

    Of candidates with a value and fresh enough, the first source counts, and its freshest
    value. Another one that is ``disagreement_ft`` away is an anomaly; if the selected one is
    of the local radio and above the envelope, the first candidate inside it counts instead.
    A value that climbs or sinks faster than ``most_ft_min`` from the last accepted one of
    the same source, not too soon or too long after it, is rejected, and the accepted one
    stays. Without a jump the choice needs no history, and after a long gap there is none,
    so chains end there.
    """
    rank = lambda c: F.array_position(F.array(*(F.lit(s) for s in ALTITUDE_SOURCES)), c["source"])
    valid = F.filter("candidates", lambda c: F.coalesce(c["altitude_ft"].isNotNull() & (F.coalesce(c["age_s"], F.lit(0)) <= fresh_s), F.lit(False)))
    ordered = F.array_sort(F.transform(valid, lambda c: F.struct(rank(c).alias("rank"), F.coalesce(c["age_s"].cast("double"), F.lit(float("inf"))).alias("age_s"), c["source"].alias("source"), c["altitude_ft"].cast("double").alias("altitude_ft"))))
    chosen = rows.withColumn("_valid", ordered).withColumn("_first", F.try_element_at("_valid", F.lit(1)))
    apart = F.exists(F.slice("_valid", 2, 1000), lambda c: F.abs(c["altitude_ft"] - F.col("_first.altitude_ft")) > disagreement_ft)
    inside = F.try_element_at(F.filter(F.slice("_valid", 2, 1000), lambda c: c["altitude_ft"] <= envelope_ft), F.lit(1))
    high = F.col("_apart") & (F.col("_first.source") == "LOCAL_BEAST") & (F.col("_first.altitude_ft") > envelope_ft) & inside.isNotNull()
    chosen = chosen.withColumn("_apart", F.coalesce(apart, F.lit(False))).withColumn("_one", F.when(high, inside).otherwise(F.col("_first")))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seen = (micros(F.col(at)) - F.coalesce(F.nullif(F.col("_one.age_s"), F.lit(float("inf"))), F.lit(0.0)) * 1_000_000).cast("long")
    chosen = chosen.select(*rows.columns, "_apart", F.when(F.col("_one").isNotNull(), F.struct(F.col("_one.source").alias("source"), F.col("_one.altitude_ft").alias("ft"), seen.alias("us"))).alias("_one"))

    def step(last: Column, row: Column) -> tuple[Column, Column]:
        one = row["_one"]
        gap = (one["us"] - last["us"]) / 1_000_000
        fast = F.abs(one["ft"] - last["ft"]) > most_ft_min / 60 * gap
        jump = F.coalesce(one.isNotNull() & (one["us"] != last["us"]) & (one["source"] == last["source"]) & (gap >= least_gap_s) & (gap < long_gap_s) & fast, F.lit(False))
        both = let(jump, lambda j: F.struct(F.when(j | one.isNull(), last).otherwise(one).alias("last"), F.struct(j.alias("jump"), F.when(j, last).otherwise(one).alias("selected")).alias("out")))
        return both["last"], both["out"]

    kind = "struct<source:string,ft:double,us:bigint>"
    decided = by_chain(chosen, [key], at, tie, long_gap_s + fresh_s, kind, f"struct<jump:boolean,selected:{kind}>", step)
    jump, source = F.col("decision.jump"), F.col("_one.source")
    reason = (
        F.when(jump, "IMPLAUSIBLE_JUMP_REJECTED").when(source.isNull() & (F.size("candidates") > 0), "INVALID_VALUE_REJECTED").when(source.isNull(), "NO_VALID_SOURCE")
        .when(source == "LOCAL_BEAST", "LOCAL_BEAST_FRESH_PRIORITY").when(source == "READSB_JSON", "READSB_JSON_FRESH_PRIORITY")
        .when(source.isin("NETWORK", "MLAT", "TIS_B"), "NETWORK_FALLBACK").otherwise("OTHER_FALLBACK")
    )
    anomaly = F.when(jump, "IMPLAUSIBLE_JUMP").when(F.col("_apart"), "DISAGREEMENT")
    return decided.select(*rows.columns, F.col("decision.selected.source").alias("selected_source"), F.col("decision.selected.ft").alias("selected_ft"), reason.alias("reason"), anomaly.alias("anomaly"))


#: Of the receivers' counters: ticks a millisecond, length, half of it, and the longest step that is believed.
TICKS_MS, WRAP, HALF, MOST = 12_000, 1 << 48, 1 << 47, 1 << 44


def receiver_clock(frames: DataFrame, key: str = "receiver", at: str = "received_at", tie: str = "event_id", drift_ms: int = 86_400_000) -> DataFrame:
    """``frames`` (ticks: a 48-bit counter, 0 or null if none) with ``observed_ms`` and ``clock``.

    Counters are unwrapped over each receiver's frames in order of arrival, as running sums
    of the steps between them. A step back that is no wrap, or too long a one, is a break:
    the frame's time is that of its arrival, and counting starts there; so does a clock that
    has run ``drift_ms`` from the time of arrival. ``clock`` says how a time was found:
    first, counted, break, drift or none (no counter: the time of arrival).
    """
    received = F.unix_micros(F.col(at).cast("timestamp")) / 1000
    ticking = F.coalesce(F.col("ticks") != 0, F.lit(False))
    frames = frames.withColumn("_ms", received)
    step_by = Steps()
    counted = carried(frames.where(ticking), [key], at, tie, _last=previous(F.struct("ticks")))
    back = F.col("ticks") - F.col("_last.ticks")
    step = F.when(back >= 0, back).when(back < -HALF, back + WRAP)
    fine = F.coalesce(step <= MOST, F.lit(False))
    counted = counted.withColumns({"_step": F.when(fine, step).otherwise(0), "_start": ~fine})
    counted = carried(step_by(counted), [key], at, tie, _sum=running_sum(F.col("_step")), _run=running_sum(F.col("_start").cast("long")))
    # How far the clock is from the time of arrival, but for a constant.
    counted = counted.withColumn("_off", F.col("_sum") / TICKS_MS - F.col("_ms"))
    counted = step_by(counted)
    runs = counted.groupBy(key, "_run").agg((F.max("_off") - F.min("_off")).alias("_range"))
    counted = counted.join(runs, [key, "_run"])
    steady = counted.where(F.col("_range") <= drift_ms).withColumn("kept", F.col("_start"))
    # Where it may have run away, starts anew depend on the last one.
    runaway = greedy(counted.where(F.col("_range") > drift_ms), [key, "_run"], at, tie, 10**9, ["_off"], lambda last, row: F.abs(row["_off"] - last["_off"]) > drift_ms)
    based = carried(step_by(steady.unionByName(runaway)), [key], at, tie, _base=last_known(F.when(F.col("kept"), F.struct("_ms", "_sum"))))
    how = F.when(~F.col("kept"), "counted").when(F.col("_last").isNull(), "first").when(F.col("_start"), "break").otherwise("drift")
    columns = [c for c in frames.columns if c != "_ms"]
    out = based.select(*columns, F.floor(F.col("_base._ms") + (F.col("_sum") - F.col("_base._sum")) / TICKS_MS).alias("observed_ms"), how.alias("clock"))
    return out.unionByName(frames.where(~ticking).select(*columns, F.floor("_ms").alias("observed_ms"), F.lit("none").alias("clock")))
