"""Bands and cells. The altitude bands differ on purpose: each belongs to one report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(value: Column, bounds: list[float], start: int = 0) -> Column:
    out = F.when(value < bounds[0], start)
    for k, b in enumerate(bounds[1:], 1):
        out = out.when(value < b, start + k)
    return F.when(value.isNotNull(), out.otherwise(start + len(bounds)))


def azimuth(bearing: Column, width: int = 10) -> Column:
    return F.least(F.lit(360 // width - 1), F.floor(bearing / width)).cast("long")


def coverage_range(nm: Column) -> Column:
    """25 NM bands; exactly 175 stays in the last."""
    return F.when(nm == 175, 6).when((nm >= 0) & (nm < 175), F.floor(nm / 25)).cast("long")


def coverage_altitude(ft: Column) -> Column:
    return F.when(ft >= 0, _bands(ft, [5000, 10000, 20000, 30000, 40000])).cast("long")


def receiver_altitude(ft: Column) -> Column:
    return _bands(ft, [5000, 15000, 30000]).cast("long")


def integrity_altitude(ft: Column) -> Column:
    return F.coalesce(_bands(ft, [10000, 20000, 30000, 40000]), F.lit(-1)).cast("long")


def profile_bin(ft: Column, size: int = 2000) -> Column:
    size = min(10000, max(500, size))
    return (F.floor(ft / size) * size).cast("long")


def grid_cell(lat: Column, lon: Column, degrees: float = 0.2) -> tuple[Column, Column]:
    return F.floor(lat / degrees).cast("long"), F.floor(lon / degrees).cast("long")


def weather_band(ft: Column) -> Column:
    """Bands of weather reports by flight level."""
    return F.when(ft < 10_000, "below_FL100").when(ft < 20_000, "FL100_FL200").when(ft < 30_000, "FL200_FL300").when(ft < 40_000, "FL300_FL400").otherwise("above_FL400")
