"""Column functions on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skytally.functions import buckets, codes, geo, text
from skytally.operators.sequences import retry_schedule


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("raw", "miles"), [("10", 10.0), ("1/2", 0.5), ("1 1/2SM", 1.5), ("P6SM", 6.0), ("M1/4SM", 0.25), ("fog", None), ("1/0", None)])
def test_visibility(spark, raw, miles):
    assert value(spark, text.visibility_miles(F.lit(raw))) == miles


@pytest.mark.parametrize(("raw", "feet"), [("SFC", 0), ("FL245", 24500), ("3500 FT", 3500), ("high", None)])
def test_altitude(spark, raw, feet):
    assert value(spark, text.altitude_feet(F.lit(raw))) == feet


@pytest.mark.parametrize(("raw", "number"), [(" 12.5 ", 12.5), ("NaN", None), ("1e400", None), ("", None), ("-3", -3.0)])
def test_number(spark, raw, number):
    assert value(spark, text.clean_number(F.lit(raw))) == number


def test_identifier(spark):
    assert value(spark, text.identifier(F.lit(" 49d1a2\t"))) == "49D1A2"
    assert value(spark, text.identifier(F.lit("49d1a"))) is None


def test_turns_and_bands(spark):
    assert value(spark, geo.turn(F.lit(350.0), F.lit(10.0))) == 20
    assert value(spark, geo.turn(F.lit(10.0), F.lit(350.0))) == -20
    assert [value(spark, buckets.coverage_range(F.lit(x))) for x in (0.0, 24.9, 25.0, 175.0, 175.1)] == [0, 0, 1, 6, None]
    assert value(spark, buckets.coverage_altitude(F.lit(-1))) is None
    assert value(spark, buckets.integrity_altitude(F.lit(None).cast("int"))) == -1
    assert value(spark, buckets.azimuth(F.lit(360.0))) == 35


def test_distance(spark):
    assert value(spark, geo.haversine_km(F.lit(50.0), F.lit(14.0), F.lit(50.0), F.lit(14.0))) == 0
    assert 240 < value(spark, geo.haversine_km(F.lit(50.1), F.lit(14.26), F.lit(48.11), F.lit(16.57))) < 290


def test_retries():
    assert retry_schedule(12)[:4] == [1, 2, 4, 8]
    assert retry_schedule(12)[-1] == 900


@pytest.mark.parametrize(
    ("raw", "degrees"),
    [("495454.10N", 49 + 54 / 60 + 54.10 / 3600), ("0150731.76E", 15 + 7 / 60 + 31.76 / 3600), ("012 43 29,00 E", 12 + 43 / 60 + 29 / 3600), (" 500000s ", -50.0), ("900000N", 90.0), ("900001N", None), ("1800000W", -180.0), ("496000N", None), ("12 4 329E", None), ("49545N", None), ("495454", None), ("", None), ("N", None), ("0124329.E", None)],
)
def test_dms(spark, raw, degrees):
    assert value(spark, text.dms_degrees(F.lit(raw))) == degrees


@pytest.mark.parametrize(
    ("raw", "area"),
    [("LKTRA36", "LKTRA36"), ("lk-tra 36a", "LKTRA36A"), ("TSA 4A", "LKTSA4A"), ("TRA 36 HOLICE", "LKTRA36"), ("LZTRA01", None), ("LZTRA01 and LKTSA_7", "LKTSA7"), ("TRA 5 and LKTRA6", "LKTRA6"), ("TRA HOLICE", None), ("TRA36AB", None), ("T.R.A. 12", "LKTRA12"), ("TRA/36 XYZ", None), ("TRA/36 X", "LKTRA36X"), ("", None), (None, None)],
)
def test_airspace_designator(spark, raw, area):
    assert value(spark, text.airspace_designator(F.lit(raw).cast("string"))) == area


@pytest.mark.parametrize(("raw", "name"), [("RWY 6", "06"), ("24l", "24L"), ("runway 36 C", "36C"), ("37", None), ("0", None), ("24X", None), (" 9 ", "09"), ("", None), ("006R", "06R"), ("0006", None), ("L", None)])
def test_runway(spark, raw, name):
    assert value(spark, codes.runway(F.lit(raw))) == name


@pytest.mark.parametrize(
    ("kind", "served", "name", "iata", "tier"),
    [("Heliport ", True, "x", "ABC", "heliport"), ("large_airport", None, "x", None, "significant"), ("small_airport", False, "x", "ABC", "small"), ("small_airport", True, "x", None, "significant"), ("closed", True, "x", "ABC", "small"), (None, True, "Big heliport", None, "significant"), (None, None, "City Helipad (north)", "ABC", "heliport"), ("other", False, "Heliportside", "ABC", "significant"), (None, None, None, "", "small")],
)
def test_airport_tier(spark, kind, served, name, iata, tier):
    lit = lambda v, t="string": F.lit(v).cast(t)
    assert value(spark, codes.airport_tier(lit(kind), lit(served, "boolean"), lit(name), lit(iata))) == tier
