"""Distances, bearings and areas on a sphere, as expressions and over arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres.
RADIUS = 6_371_000.0


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, -180 to 180."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def box_area_m2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Area of a longitude-latitude box on the sphere."""
    return F.lit(RADIUS**2) * F.radians(max_lon - min_lon) * (F.sin(F.radians(max_lat)) - F.sin(F.radians(min_lat)))


def distance_np(lon1, lat1, lon2, lat2):
    dlat, dlon = np.radians(lat2 - lat1), np.radians(lon2 - lon1)
    h = np.sin(dlat / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(dlon / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def distance_py(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(min(h, 1.0)))


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    """Whether segments ab and cd cross properly; parallel ones do not."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def simplify(lon: np.ndarray, lat: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker over planar degrees: the indices to keep, without recursion."""
    keep = np.zeros(len(lon), dtype=bool)
    if len(lon):
        keep[[0, -1]] = True
    spans = [(0, len(lon) - 1)]
    while spans:
        first, last = spans.pop()
        if last - first < 2:
            continue
        x, y = lon[first : last + 1] - lon[first], lat[first : last + 1] - lat[first]
        length = np.hypot(x[-1], y[-1])
        away = np.hypot(x, y) if length == 0 else np.abs(x * y[-1] - y * x[-1]) / length
        at = int(away.argmax())
        if away[at] > tolerance:
            keep[first + at] = True
            spans += [(first, first + at), (first + at, last)]
    return np.nonzero(keep)[0]


def in_rings(lon: np.ndarray, lat: np.ndarray, rings: list[list[tuple[float, float]]]) -> np.ndarray:
    """Even-odd containment in a polygon or multipolygon given as all its rings."""
    inside = np.zeros(len(lon), dtype=bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                crosses = (y1 > lat) != (y2 > lat)
                inside ^= crosses & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    return inside
