"""Folds over chains and scans over days against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from skytally.operators import folds, scans

START = datetime(2024, 1, 1, 22)


def km(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * asin(min(1, sqrt(h)))


@pytest.fixture(scope="module")
def tracks():
    """Rows (event_id, icao_hex, observed_at, lat, lon): dense, with jumps, equal times, gaps of hours and days."""
    rng, rows = random.Random(5), []
    for k in range(6):
        at, lat, lon = START, 50.0, 15.0
        for _ in range(300 if k < 2 else 40):
            at += timedelta(seconds=rng.choice([0, 1, 5, 20, 20, 20, 60, 4000, 60_000, 200_000] if k else [0, 1, 2, 5]))
            lat, lon = lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-0.02, 0.02)
            far = rng.random() < 0.15
            rows.append((len(rows), f"A{k}", at, lat + 5 * far, lon))
    rng.shuffle(rows)
    return rows


def loop(rows, keep):
    """Which rows a plain loop keeps, each against the last one it kept."""
    last, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out[r[0]] = r[1] not in last or keep(last[r[1]], r)
        if out[r[0]]:
            last[r[1]] = r
    return out


def seconds(a, b):
    return (b[2] - a[2]).total_seconds()


@pytest.mark.parametrize(
    ("fold", "keep"),
    [
        (lambda d: folds.plausible_positions(d, ["icao_hex"]), lambda a, b: seconds(a, b) > 0 and km(a[3:], b[3:]) <= 0.45 * seconds(a, b)),
        (lambda d: folds.credible_positions(d, ["icao_hex"]), lambda a, b: seconds(a, b) <= 0 or km(a[3:], b[3:]) <= max(25, 900 * 1.852 * 1.5 / 3600 * seconds(a, b))),
        (lambda d: folds.sampled(d, ["icao_hex"]), lambda a, b: seconds(a, b) >= 20),
    ],
    ids=["plausible", "credible", "sampled"],
)
def test_greedy(spark, tracks, fold, keep):
    frame = spark.createDataFrame(tracks, "event_id long, icao_hex string, observed_at timestamp, lat double, lon double").repartition(7)
    got = {r.event_id: r.kept for r in fold(frame).collect()}
    assert got == loop(tracks, keep) and 0 < sum(got.values()) < len(got)


def test_bounded_trail(spark):
    """Equal rows count once, the later of two at one place stays, a jump is left out, and the newest bound what is kept."""
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, "A", at(0), 50.0, 15.0), (2, "A", at(0), 50.0, 15.0), (3, "A", at(10), 50.0, 15.0), (4, "A", at(20), 50.01, 15.0), (5, "A", at(30), 60.0, 15.0), (6, "A", at(40), 50.03, 15.0), (7, "A", at(50), 50.03, 15.0)]
    frame = spark.createDataFrame(rows, "event_id long, icao_hex string, observed_at timestamp, lat double, lon double")
    trail = lambda **k: sorted(r.event_id for r in folds.bounded_trail(frame, "icao_hex", **k).collect())
    assert trail() == [3, 4, 7] and trail(most=2) == [4, 7] and trail(max_age_s=5) == [7]
    assert folds.bounded_trail(frame.limit(0), "icao_hex").count() == 0


def test_scans(spark, tracks):
    frame = spark.createDataFrame([(*r, r[0] % 4 if r[0] % 3 else None) for r in tracks], "event_id long, icao_hex string, observed_at timestamp, lat double, lon double, v long").repartition(5)
    out = scans.carried(frame, ["icao_hex"], "observed_at", "event_id", prev=scans.previous(F.struct("event_id")), next=scans.following(F.struct("event_id")), total=scans.running_sum(F.col("v")), known=scans.last_known(F.col("v")), before=scans.last_known(F.col("v"), own=False), ahead=scans.next_known(F.col("v")))
    got = {r.event_id: (r.prev and r.prev.event_id, r.next and r.next.event_id, r.total, r.known, r.before, r.ahead) for r in out.collect()}
    want = {}
    for key in {r[1] for r in tracks}:
        rows = sorted((r for r in tracks if r[1] == key), key=lambda r: (r[2], r[0]))
        v = [r[0] % 4 if r[0] % 3 else None for r in rows]
        last = lambda xs: next((x for x in reversed(xs) if x is not None), None)
        for i, r in enumerate(rows):
            want[r[0]] = (rows[i - 1][0] if i else None, rows[i + 1][0] if i + 1 < len(rows) else None, sum(x or 0 for x in v[: i + 1]), last(v[: i + 1]), last(v[:i]), last(v[:i:-1]))
    assert got == want


def test_weather_persistence(spark):
    """Reasons in their order; what was rejected changes nothing; after a gap the row stored before it still counts."""
    at = lambda s: START + timedelta(seconds=s)
    row = lambda i, s, source="READSB", quality="GOOD", alt=3000, t=5.0, wind=100.0, kt=20.0, provider="local": (i, "A", at(s), 50.0, 15.0, alt, wind, kt, t, source, provider, quality)
    rows = [row(1, 0, quality="HIGH"), row(2, 10), row(3, 20, t=6.0), row(4, 30, quality="REJECTED", alt=9000), row(5, 40, wind=350.0, t=6.0), row(6, 50, wind=4.0, t=6.0), row(7, 60, wind=6.0, t=6.0), row(8, 70, wind=6.0, t=6.0, alt=4000), row(9, 80, wind=6.0, t=6.0, alt=4000, quality="DEGRADED")]
    rows += [row(10, 90, "BDS_4_4"), row(11, 100, "BDS_4_4"), row(12, 110, "BDS_4_4"), row(13, 120), row(14, 130, t=None), row(15, 249, t=None), row(16, 250, t=None), row(17, 100_000, t=None, provider="network"), row(18, 200_000, t=None, provider="network")]
    frame = spark.createDataFrame(rows, "event_id long, icao_hex string, observed_at timestamp, lat double, lon double, altitude_ft long, wind_from double, wind_kt double, temperature_c double, source string, provider string, quality string").repartition(4)
    got = {r.event_id: r.reason for r in folds.weather_persistence(frame).collect()}
    assert got == {
        1: "FIRST_OBSERVATION", 2: None, 3: "WEATHER_CHANGE", 4: None, 5: "WEATHER_CHANGE", 6: None, 7: "WEATHER_CHANGE", 8: "ALTITUDE_BIN_CHANGE", 9: "QUALITY_CHANGE", 10: "BDS44_UNIQUE", 11: None, 12: "BDS44_UNIQUE",
        13: "SOURCE_CHANGE", 14: "WEATHER_CHANGE", 15: None, 16: "HEARTBEAT", 17: "SOURCE_CHANGE", 18: "HEARTBEAT",
    }


def test_altitude_arbitration(spark):
    at = lambda s: START + timedelta(seconds=s)
    beast, json, net = (lambda ft, age=1.0, s=s: (s, ft, age) for s in ("LOCAL_BEAST", "READSB_JSON", "NETWORK"))
    cases = [
        ([net(9000.0), json(10_000.0), beast(10_100.0)], ("LOCAL_BEAST", 10_100.0, "LOCAL_BEAST_FRESH_PRIORITY", None)),
        ([beast(126_000.0), json(10_200.0)], ("READSB_JSON", 10_200.0, "READSB_JSON_FRESH_PRIORITY", "DISAGREEMENT")),
        ([json(40_000.0)], ("READSB_JSON", 10_200.0, "IMPLAUSIBLE_JUMP_REJECTED", "IMPLAUSIBLE_JUMP")),
        ([beast(None), json(10_300.0, 31.0)], (None, None, "INVALID_VALUE_REJECTED", None)),
        ([], (None, None, "NO_VALID_SOURCE", None)),
        ([json(10_400.0), net(30_000.0)], ("READSB_JSON", 10_400.0, "READSB_JSON_FRESH_PRIORITY", "DISAGREEMENT")),
        ([("MLAT", 12_000.0, None)], ("MLAT", 12_000.0, "NETWORK_FALLBACK", None)),
    ]
    frame = spark.createDataFrame([(k, "A", at(10 * k), c) for k, (c, _) in enumerate(cases)] + [(99, "A", at(900), [json(60_000.0)])], "event_id long, icao_hex string, observed_at timestamp, candidates array<struct<source:string,altitude_ft:double,age_s:double>>")
    got = {r.event_id: (r.selected_source, r.selected_ft, r.reason, r.anomaly) for r in folds.altitude_arbitration(frame).collect()}
    assert got == {k: w for k, (_, w) in enumerate(cases)} | {99: ("READSB_JSON", 60_000.0, "READSB_JSON_FRESH_PRIORITY", None)}


def test_receiver_clock(spark):
    """A wrap is counted on, a step back and a long one are breaks, frames without a counter stand apart, and a clock that runs away starts anew."""
    at = lambda s: START + timedelta(seconds=s)
    tick = 12_000_000
    rows = [(1, "R", at(0), folds.WRAP - 5 * tick), (2, "R", at(10), 0), (3, "R", at(10.5), 5 * tick), (4, "R", at(20), 15 * tick), (5, "R", at(30), 1 * tick), (6, "R", at(40), 11 * tick + 60), (7, "R", at(50), 2**45), (8, "R", at(60), 2**45 + 100_000 * tick), (9, "R", at(70), 2**45 + 100_001 * tick), (10, "Q", at(0), None)]
    frame = spark.createDataFrame(rows, "event_id long, receiver string, received_at timestamp, ticks long")
    base = spark.createDataFrame([(START,)], "t timestamp").select(F.unix_millis("t")).first()[0]
    got = {r.event_id: (r.observed_ms - base, r.clock) for r in folds.receiver_clock(frame).collect()}
    assert got == {1: (0, "first"), 2: (10_000, "none"), 3: (10_000, "counted"), 4: (20_000, "counted"), 5: (30_000, "break"), 6: (40_000, "counted"), 7: (50_000, "break"), 8: (60_000, "drift"), 9: (61_000, "counted"), 10: (0, "none")}
