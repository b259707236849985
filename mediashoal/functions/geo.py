"""Great-circle search: a bounding box that reaches the scan, and the exact distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32


def valid(lat: float | None, lng: float | None, radius_km: float | None) -> bool:
    if lat is None or lng is None or radius_km is None:
        return False
    return -90 <= lat <= 90 and -180 <= lng <= 180 and math.isfinite(radius_km) and radius_km > 0


def bounding_box(lat: float, lng: float, radius_km: float) -> tuple[float, float, float | None, float | None]:
    """Latitudes, and longitudes or None where the box touches a pole; no wrap."""
    d = radius_km / KM_PER_DEGREE
    south, north = max(-90.0, lat - d), min(90.0, lat + d)
    if south <= -90 or north >= 90:
        return south, north, None, None
    w = radius_km / (KM_PER_DEGREE * max(abs(math.cos(math.radians(lat))), 0.01))
    return south, north, max(-180.0, lng - w), min(180.0, lng + w)


def haversine(lat: Column, lng: Column, at_lat: float, at_lng: float) -> Column:
    d_lat, d_lng = F.radians(lat - F.lit(at_lat)), F.radians(lng - F.lit(at_lng))
    a = F.pow(F.sin(d_lat / 2), 2) + F.lit(math.cos(math.radians(at_lat))) * F.cos(F.radians(lat)) * F.pow(F.sin(d_lng / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def within(lat: Column, lng: Column, at_lat: float, at_lng: float, radius_km: float, box: bool = True) -> Column:
    """Both the box and the distance, as the box is part of the meaning; ``box=False``
    is the distance alone."""
    near = haversine(lat, lng, at_lat, at_lng) <= radius_km
    if not box:
        return near
    south, north, west, east = bounding_box(at_lat, at_lng, radius_km)
    inside = (lat >= south) & (lat <= north)
    if west is not None:
        inside = inside & (lng >= west) & (lng <= east)
    return inside & near


def distance(lat: Column, lng: Column, at_lat: Column, at_lng: Column) -> Column:
    """``haversine`` to a place that is a column too."""
    d_lat, d_lng = F.radians(lat - at_lat), F.radians(lng - at_lng)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(at_lat)) * F.cos(F.radians(lat)) * F.pow(F.sin(d_lng / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def box_of(lat: Column, lng: Column, radius_km: Column) -> tuple[Column, Column, Column, Column]:
    """``bounding_box`` of columns; all longitudes where it touches a pole."""
    d = radius_km / KM_PER_DEGREE
    south, north = F.greatest(F.lit(-90.0), lat - d), F.least(F.lit(90.0), lat + d)
    w = radius_km / (KM_PER_DEGREE * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.01)))
    pole = (south <= -90) | (north >= 90)
    west = F.when(pole, F.lit(-180.0)).otherwise(F.greatest(F.lit(-180.0), lng - w))
    return south, north, west, F.when(pole, F.lit(180.0)).otherwise(F.least(F.lit(180.0), lng + w))


#: Halvings of latitudes and of longitudes that a cell comes from; and ranges of a cover.
LEVELS, RANGES = 15, 32


def step(value: Column, span: float, low: float, level: Column | int) -> Column:
    """Which of the 2**level equal strips a coordinate is in; the last one has its upper end."""
    n = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
    return F.greatest(F.lit(0.0), F.least(F.floor((value - low) / span * n).cast("double"), n - 1)).cast("int")


def cell(lat: Column, lng: Column) -> Column:
    """The Z-order number of a place: bits of latitude and longitude in turn."""
    y, x = step(lat, 180, -90, LEVELS), step(lng, 360, -180, LEVELS)
    out = F.lit(0).cast("int")
    for k in range(LEVELS):
        out = out + F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k + 1) + F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k)
    return F.when(lat.isNotNull() & lng.isNotNull(), out)


def cover(south: float, north: float, west: float, east: float) -> list[tuple[int, int]]:
    """Ranges of cells that hold a box: quarters are split, the largest first, while they lie
    across its border and there are not too many of them."""
    strip = lambda v, span, low: max(0, min(math.floor((v - low) / span * (1 << LEVELS)), (1 << LEVELS) - 1))
    y0, y1, x0, x1 = strip(south, 180, -90), strip(north, 180, -90), strip(west, 360, -180), strip(east, 360, -180)
    open_, whole = [(0, 0, LEVELS, 0)], []  # y, x, level, first cell
    while open_ and len(open_) + len(whole) < RANGES * 4:
        y, x, level, first = open_.pop(0)
        size = 1 << level
        if y > y1 or x > x1 or y + size <= y0 or x + size <= x0:
            continue
        if y >= y0 and x >= x0 and y + size - 1 <= y1 and x + size - 1 <= x1:
            whole.append((first, level))
            continue
        half, quarter = size >> 1, 1 << 2 * (level - 1)
        open_ += [(y + half * (k >> 1), x + half * (k & 1), level - 1, first + k * quarter) for k in range(4)]
    touched = [(f, v) for y, x, v, f in open_ if not (y > y1 or x > x1 or y + (1 << v) <= y0 or x + (1 << v) <= x0)]
    merged: list[list[int]] = []
    for first, level in sorted(whole + touched):
        last = first + (1 << 2 * level) - 1
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    while len(merged) > RANGES:  # join those with the least between them
        k = min(range(len(merged) - 1), key=lambda k: merged[k + 1][0] - merged[k][1])
        merged[k : k + 2] = [[merged[k][0], merged[k + 1][1]]]
    return [(low, high) for low, high in merged]
