"""Spherical geometry as column expressions (degrees in, kilometres and degrees out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_NM = 3440.065


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def within_km(lat: Column, lon: Column, at_lat: float, at_lon: float, km: float) -> Column:
    """A box that the scan can filter by, and the exact distance behind it."""
    dlat = math.degrees(km / EARTH_KM)
    box = lat.between(at_lat - dlat, at_lat + dlat)
    dlon = dlat / max(0.01, math.cos(math.radians(min(89.0, abs(at_lat) + dlat))))
    if abs(at_lon) + dlon < 180:
        box &= lon.between(at_lon - dlon, at_lon + dlon)
    return box & (haversine_km(lat, lon, F.lit(at_lat), F.lit(at_lon)) <= km)


def destination(lat: Column, lon: Column, course: Column, km: Column, radius: float = EARTH_KM) -> tuple[Column, Column]:
    d, c, p = km / radius, F.radians(course), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(c))
    dl = F.atan2(F.sin(c) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.degrees(to), F.pmod(lon + F.degrees(dl) + 540, F.lit(360.0)) - 180


def turn(a: Column, b: Column) -> Column:
    """Signed shortest turn from a to b, -180 to 180."""
    return F.pmod(b - a + 540, F.lit(360.0)) - 180


def wind_components(direction: Column, speed: Column) -> tuple[Column, Column]:
    """East and north parts of a wind given by where it comes from."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def runway_wind(heading: Column, direction: Column, speed: Column) -> tuple[Column, Column]:
    """Head and cross part, to a tenth of a knot."""
    angle = F.radians(turn(heading, direction))
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    return tenth(speed * F.cos(angle)), tenth(speed * F.sin(angle))


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a closed ring of (lat, lon), by crossings to its east."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def segment_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> Column:
    """Distance of a point from a great-circle segment, its ends included; null for a coordinate out of bounds."""
    whole, near = haversine_km(lat1, lon1, lat2, lon2), haversine_km(lat1, lon1, lat, lon)
    apart = F.radians(bearing(lat1, lon1, lat, lon)) - F.radians(bearing(lat1, lon1, lat2, lon2))
    angle = near / EARTH_KM
    along = F.atan2(F.sin(angle) * F.cos(apart), F.cos(angle)) * EARTH_KM
    across = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(angle) * F.sin(apart))))) * EARTH_KM
    valid = lat1.between(-90, 90) & lat2.between(-90, 90) & lat.between(-90, 90) & lon1.between(-180, 180) & lon2.between(-180, 180) & lon.between(-180, 180)
    return F.when(valid, F.when((whole == 0) | (along <= 0), near).when(along >= whole, haversine_km(lat2, lon2, lat, lon)).otherwise(across))


def along_across_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """How far along the great circle from the first point to the second, and how far to the right of it."""
    angle = haversine_km(lat1, lon1, lat, lon) / EARTH_KM
    apart = F.radians(bearing(lat1, lon1, lat, lon)) - F.radians(bearing(lat1, lon1, lat2, lon2))
    return F.atan2(F.sin(angle) * F.cos(apart), F.cos(angle)) * EARTH_KM, F.asin(F.sin(angle) * F.sin(apart)) * EARTH_KM


def circle(lat: Column, lon: Column, km: Column, points: int = 72) -> Column:
    """A closed ring of (lat, lon) at a distance."""

    def at(k: Column) -> Column:
        to_lat, to_lon = destination(lat, lon, k * (360.0 / points), F.lit(km))
        return F.struct(to_lat.alias("lat"), to_lon.alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), at)


def ring_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Least and greatest latitude, least and greatest longitude."""
    lats, lons = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return F.array_min(lats), F.array_max(lats), F.array_min(lons), F.array_max(lons)


def ring_side(lat: Column, lon: Column, ring: Column, near: float = 1e-9) -> Column:
    """inside, boundary or outside of a ring of (lat, lon), closed or not; null for a null point or under three corners.

    Longitudes of the ring are taken on the point's side of the date line.
    """
    corners = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    own = lambda p: F.struct(p["lat"].alias("y"), (lon + turn(lon, p["lon"])).alias("x"))
    edges = F.transform(corners, lambda e: F.struct(own(e["a"]).alias("a"), own(e["b"]).alias("b")))

    def on(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        cross = (lon - ax) * (by - ay) - (lat - ay) * (bx - ax)
        return (F.abs(cross) <= near) & ((lon - ax) * (lon - bx) + (lat - ay) * (lat - by) <= near)

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / (by - ay) + ax)

    # All edges at one go: -1 once on one, otherwise whether the crossings are odd.
    state = F.aggregate(edges, F.lit(0), lambda s, e: F.when((s < 0) | on(e), F.lit(-1)).when(crosses(e), 1 - s).otherwise(s))
    found = F.element_at(F.array(F.lit("boundary"), F.lit("outside"), F.lit("inside")), state + 2)
    return F.when(lat.isNotNull() & lon.isNotNull() & (F.size(ring) >= 3), found)


def polygon_side(lat: Column, lon: Column, rings: Column) -> Column:
    """The same for an outer ring with holes: within a hole is outside, on its edge is boundary."""
    outer = ring_side(lat, lon, F.element_at(rings, 1))
    holes = F.transform(F.slice(rings, 2, F.size(rings)), lambda r: ring_side(lat, lon, r))
    return F.when(outer != "inside", outer).when(F.array_contains(holes, "boundary"), "boundary").when(F.array_contains(holes, "inside"), "outside").otherwise(outer)


def great_circle_points(lat1: Column, lon1: Column, lat2: Column, lon2: Column, step_km: float = 222.0, most: int = 64) -> Column:
    """Points (lat, lon) from one end to the other, evenly apart, with longitudes that do not jump."""
    d = haversine_km(lat1, lon1, lat2, lon2)
    n = F.least(F.lit(most - 1), F.greatest(F.lit(1), F.ceil(d / step_km))).cast("int")
    course = bearing(lat1, lon1, lat2, lon2)

    def at(k: Column) -> Column:
        lat, lon = destination(lat1, lon1, course, d * k / n)
        return F.struct(lat.alias("lat"), (lon1 + turn(lon1, lon)).alias("lon"))

    return F.transform(F.sequence(F.lit(0), n), at)


def flight_category(ceiling_ft: Column, visibility_m: Column, less: Column) -> Column:
    """VFR, MVFR, IFR or LIFR, by the worse of ceiling and visibility; null without both."""
    miles = visibility_m / 1609.344
    ceiling = F.when(ceiling_ft.isNull(), 0).when(ceiling_ft < 500, 3).when(ceiling_ft < 1000, 2).when(ceiling_ft <= 3000, 1).otherwise(0)
    sight = F.when(miles.isNull(), 0).when((less & (miles <= 1)) | (miles < 1), 3).when(miles < 3, 2).when(miles <= 5, 1).otherwise(0)
    return F.when(ceiling_ft.isNotNull() | miles.isNotNull(), F.element_at(F.array(*map(F.lit, ("VFR", "MVFR", "IFR", "LIFR"))), F.greatest(ceiling, sight) + 1))


def cell_cover(low_lat: Column, high_lat: Column, low_lon: Column, high_lon: Column, degrees: float = 1.0) -> Column:
    """All grid cells (lat, lon) that a box touches, for a join by cell."""
    steps = lambda a, b: F.sequence(F.floor(a / degrees), F.floor(b / degrees))
    return F.flatten(F.transform(steps(low_lat, high_lat), lambda la: F.transform(steps(low_lon, high_lon), lambda lo: F.struct(la.alias("la"), lo.alias("lo")))))


def ring_reach(ring: Column, margin: float = 1e-4) -> tuple[Column, Column, Column, Column]:
    """The box of a ring, wide enough for points on its boundary; all longitudes if it crosses the date line."""
    south, north, west, east = ring_box(ring)
    wide = east - west > 180
    return south - margin, north + margin, F.when(wide, -180.0).otherwise(west - margin), F.when(wide, 180.0).otherwise(east + margin)


def cell(lat: Column, lon: Column, degrees: float = 1.0) -> Column:
    return F.struct(F.floor(lat / degrees).alias("la"), F.floor(lon / degrees).alias("lo"))
