"""Operators on small tables: cases that the derived frames do not have."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skytally.functions import codes, geo, text
from skytally.operators import matching, records, receiver, reports, sequences
from skytally.sources import feeds

START = datetime(2024, 1, 1, 12)


def at(seconds):
    return START + timedelta(seconds=seconds)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers(spark):
    cases = {"12": 12.0, "\t12 ": 12.0, " 7": 7.0, "0x1F40": 8000.0, "1e3": 1000.0, ".5": 0.5, "1d": None, "NaN": None, "Infinity": None, "1e999": None, "": None, "12 3": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", text.clean_number(F.col("raw")).alias("v")).collect()
    assert {r.raw: r.v for r in rows} == cases


def test_kinds_and_states(spark):
    kind = lambda k, m=False, t=False: value(spark, text.source_kind(F.lit(k).cast("string"), F.lit(m), F.lit(t)))
    assert [kind("adsr_icao"), kind("mlat_x"), kind("tisb_trackfile"), kind("mode-s"), kind("nonsense", m=True), kind(None, t=True), kind(None)] == ["ADS-B", "MLAT", "TIS-B", "Mode-S", "MLAT", "TIS-B", "UNKNOWN"]
    state = lambda s: value(spark, text.emergency_state(F.lit(s)))
    assert [state("7500"), state("2"), state(" General "), state("None"), state("")] == ["7500", None, "general", None, None]
    assert text.is_wildcard("AB*") and not text.is_wildcard("A[B]") and not text.is_wildcard("  ")


def test_sessions(spark):
    rows = [(1, "A", at(0), None, 0, 5.0, None), (2, "A", at(60), "X1", None, 4.0, "B738"), (3, "A", at(120), "X1", 300, None, None), (4, "A", at(180), "Y2", 0, 9.0, "A320"), (5, "A", at(1000), None, 0, 1.0, None), (6, "B", at(0), "Z", 0, 2.0, None)]
    calls = spark.createDataFrame(rows, "event_id long, icao_hex string, observed_at timestamp, callsign string, altitude_ft long, distance_km double, aircraft_type string")
    us = lambda s: int(at(s).timestamp() * 1e6)
    got = [tuple(r) for r in reports.sessions(calls).orderBy("icao_hex", "session").collect()]
    base = us(0) - value(spark, F.unix_micros(F.lit(at(0)).cast("timestamp")))
    assert [g[:5] + (g[8], g[9]) for g in got] == [("A", 0, "X1", "B738", 3, 300, 4.0), ("A", 1, "Y2", "A320", 1, 0, 9.0), ("A", 2, None, None, 1, 0, 1.0), ("B", 0, "Z", None, 1, 0, 2.0)]
    # Another call sign ends a flight when it comes, a gap when it was last seen; the last one is open.
    assert [None if g[7] is None else g[7] + base for g in got] == [us(180), us(180), None, None]
    assert [g[6] + base for g in got] == [us(180), us(180), us(1000), us(0)]


KIND = "icao_hex string, event_id long, callsign string, source string, altitude_ft double, on_ground boolean, emergency string, squawk string, lat double, lon double, seen double, seen_pos double, last_seen_us long, position_us long, ground_speed double, track double, origin string"


def record(origin, last_s, **fields):
    base = {"icao_hex": "A", "event_id": 1, "lat": 50.0, "lon": 15.0, "seen": 0.0, "seen_pos": 0.0, "origin": origin, "last_seen_us": last_s * 10**6, "position_us": last_s * 10**6, "altitude_ft": 100.0 if origin == "local" else 200.0, "on_ground": False}
    names = [f.split()[0] for f in KIND.split(", ")]
    return tuple((base | fields).get(n) for n in names)


@pytest.mark.parametrize(
    ("local", "network", "expected"),
    [
        ((100, {}), (100, {"lat": 51.0}), ("overlap", "local", 50.0, 100.0, None, None)),
        ((100, {"lat": None}), (100, {"lat": 51.0}), ("overlap", "network", 51.0, 200.0, None, None)),
        ((100, {"lat": None}), (60, {"lat": 51.0}), ("overlap", None, None, 100.0, None, None)),
        (None, (100, {"lat": 51.0, "seen_pos": None, "position_us": None}), ("network", None, None, 200.0, None, None)),
        ((10, {}), None, ("local", "local", 50.0, 100.0, None, None)),
        ((98, {"emergency": "7700", "squawk": "7700"}), (100, {"emergency": "general", "squawk": "1000"}), ("overlap", "local", 50.0, 100.0, "general", "1000")),
        ((100, {"emergency": "lifeguard", "squawk": "2000"}), (100, {"emergency": "7600", "squawk": "7600"}), ("overlap", "local", 50.0, 100.0, "lifeguard", "2000")),
        ((50, {"squawk": "2000"}), (100, {"squawk": "3000"}), ("overlap", "local", 50.0, 100.0, None, "3000")),
    ],
)
def test_merge_feeds(spark, local, network, expected):
    side = lambda given, origin: spark.createDataFrame([record(origin, given[0], **given[1])] if given else [], KIND)
    row = reports.merge_feeds(side(local, "local"), side(network, "network"), F.lit(100 * 10**6)).first()
    assert (row.membership, row.position_origin, row.lat, row.altitude_ft, row.emergency, row.squawk) == expected


def test_snapshot_delta_sees_nulls(spark):
    kind = "k long, lat double, lon double"
    before = spark.createDataFrame([(1, None, 5.0), (2, 1.0, 1.0), (3, None, None), (4, 0.0, 0.0)], kind)
    after = spark.createDataFrame([(1, 5.0, None), (2, 1.0, 1.0), (3, None, None), (5, 0.0, 0.0)], kind)
    assert {(r.k, r.change) for r in sequences.snapshot_delta(before, after, "k").collect()} == {(1, "changed"), (4, "removed"), (5, "added")}


def test_ranks(spark):
    values = {"a": [5.0, 1.0, 1.0, 9.5, 9.4, -3.0], "b": [2.0], "c": [1.0] * 7 + [100.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("b", None), ("d", None)], "k string, v double")
    n = F.col("n")
    got = {r.k: (r.low, r.mid, r.p90) for r in receiver.at_ranks(rows, ["k"], "v", {"low": F.lit(0), "mid": F.floor((n - 1) * 0.5), "p90": F.floor((n - 1) * 0.9)}, 2.0).collect()}
    assert got == {k: tuple(sorted(vs)[int((len(vs) - 1) * f)] for f in (0, 0.5, 0.9)) for k, vs in values.items()}


def test_rings(spark):
    ring = F.array(*(F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in ((0.0, 179.0), (0.0, -179.0), (2.0, -179.0), (2.0, 179.0))))
    side = lambda y, x: value(spark, geo.ring_side(F.lit(y), F.lit(x), ring))
    assert [side(1.0, 180.0), side(1.0, -179.5), side(1.0, 178.0), side(0.0, 179.5), side(2.0, -179.0)] == ["inside", "inside", "outside", "boundary", "boundary"]
    assert value(spark, geo.ring_side(F.lit(None).cast("double"), F.lit(0.0), ring)) is None
    points = value(spark, geo.great_circle_points(F.lit(50.0), F.lit(170.0), F.lit(40.0), F.lit(-150.0)))
    assert abs(points[-1].lat - 40) < 1e-6 and abs(points[-1].lon - 210) < 1e-6 and all(0 < b.lon - a.lon < 5 for a, b in zip(points, points[1:]))


def test_apply_delta(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    changed, removed = spark.createDataFrame([(2, "B"), (4, "D")], "k long, v string"), spark.createDataFrame([(3,)], "k long")
    assert sorted(map(tuple, records.apply_delta(state, changed, removed, "k", 5, 5).collect())) == [(1, "a"), (2, "B"), (4, "D")]
    assert records.apply_delta(state, changed, removed, "k", 4, 5) is state
    with pytest.raises(ValueError):
        records.apply_delta(state, changed, removed, "k", 7, 5)
    with pytest.raises(ValueError):
        records.apply_delta(state, changed, changed.select("k"), "k", 5, 5)


def test_weather_jumps_by_the_nearest_millisecond(spark):
    """15.0004 s is a jump, 15.0005 s is none, half a millisecond comes after nothing."""
    rows = [(k, hexa, START + timedelta(microseconds=us), 100, t, 10, 0.0) for k, (hexa, us, t) in enumerate([("A", 600, -60), ("A", 15_001_400, 0), ("B", 400, -60), ("B", 15_000_900, 0), ("C", 0, -60), ("C", 499, 0), ("D", 0, -60), ("D", 500, 0)])]
    samples = spark.createDataFrame(rows, "event_id long, icao_hex string, observed_at timestamp, altitude_ft long, temperature_c long, wind_kt long, wind_from double")
    got = {r.event_id: r.quality for r in records.weather_quality(samples).collect()}
    assert [got[k] for k in range(8)] == ["HIGH", "REJECTED", "HIGH", "GOOD", "HIGH", "GOOD", "HIGH", "REJECTED"]


def test_nearest_points_keep_one_row_an_observation(spark):
    points = spark.createDataFrame([("B", 50.0, 15.0), ("A", 50.0, 15.0), ("C", 53.0, 15.0), ("D", 20.0, 15.0)], "icao string, plat double, plon double")
    obs = spark.createDataFrame([(1, 50.1, 15.0), (2, 52.9, 15.1), (3, 14.0, 15.0), (4, 15.0, 10.0), (5, 57.9, 15.0)], "event_id long, lat double, lon double")
    found = matching.nearest_points(obs, points)
    # Of equally near ones the least name; 5 degrees away is within reach.
    assert {r.event_id: r.icao for r in found.collect()} == {1: "A", 2: "C", 4: "D", 5: "C"}
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_hazards_test_few_rings_and_cross_the_date_line(spark):
    corners = ((0.0, 179.0), (0.0, -179.0), (2.0, -179.0), (2.0, 179.0))
    ring = F.array(*(F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in corners))
    areas = spark.range(1).select(F.lit(7).alias("sector_id"), ring.alias("ring"), F.lit(0).alias("lower_ft"), F.lit(1000).alias("upper_ft"))
    rows = [(1, 1.0, 179.5, 500, 0.0, 0.0), (2, 1.0, -179.5, 500, 0.0, 0.0), (3, 1.0, 178.9, 500, 90.0, 60.0), (4, 1.0, 179.5, 2000, 0.0, 0.0), (5, 1.0, 170.0, 500, 90.0, 60.0)]
    obs = spark.createDataFrame(rows, "event_id long, lat double, lon double, altitude_ft long, track double, ground_speed double")
    found = matching.hazards(obs, areas)
    # A knot of 60 is a minute of arc each minute: six of them to longitude 179.
    assert {(r.event_id, r.minute, r.relation) for r in found.collect()} == {(1, 0, "current"), (2, 0, "current"), (3, 7, "projected")}


def test_station_lines_are_split_once(spark):
    line = "MSG,3,1,1,4ca2d6,1,,,,, CS1 ,1200,,,50.25,14.5,,7700,,,,-1"
    lines = spark.createDataFrame([(1, at(0), line), (2, at(1), line.replace("50.25", "")), (3, at(2), "MSG,3"), (4, at(3), line.replace("1200", "1300").replace("50.25,14.5", ","))], "event_id long, observed_at timestamp, line string")
    messages = feeds.station_messages(lines)
    assert {r.event_id: r.error for r in messages.collect()} == {1: None, 2: "invalid_position", 3: "malformed", 4: None}
    found = feeds.tracks(messages)
    assert [(r.icao_hex, r.messages, r.callsign, r.altitude_ft, r.lat, r.position_us < r.last_us) for r in found.collect()] == [("4CA2D6", 2, "CS1", 1300.0, 50.25, True)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_csv_lines(spark):
    rows = spark.createDataFrame([(1, 'a "b", c', None), (2, None, 1.5), (3, "x\ny", 0.0)], "k long, t string, v double")
    assert [r.line for r in records.csv_lines(rows, ["k", "t", "v"]).collect()] == ['1,"a ""b"", c",', "2,,1.5", '3,"x\ny",0.0']


def test_crc24(spark):
    def plain(message):
        bits, rest = int(message, 16) >> 24, 0
        n = (len(message) - 6) * 4
        for k in range(n):
            rest ^= ((bits >> (n - 1 - k)) & 1) << 23
            rest = ((rest << 1) ^ 0xFFF409 if rest & 0x800000 else rest << 1) & 0xFFFFFF
        return rest ^ int(message[-6:], 16)

    messages = ["8D4840D6202CC371C32CE0576098", "8D40621D58C382D690C8AC2863A7", "5D4840D6F1B2A3", "00000000000000", "8D4840D6202CC371C32CE0576099"]
    rows = spark.createDataFrame([(m,) for m in messages], "m string").select("m", codes.crc24(F.col("m")).alias("c")).collect()
    assert {r.m: r.c for r in rows} == {m: plain(m) for m in messages}
    assert [r.c for r in rows][:2] == [0, 0]


def test_callsign_bits(spark):
    letters = "_ABCDEFGHIJKLMNOPQRSTUVWXYZ_____ _______________0123456789______"
    field = 0
    for c in "CSA42 _ ":
        field = field << 6 | letters.index(c)
    assert value(spark, codes.packed_callsign(F.lit(field).cast("long"))) == "CSA42"
