"""Spherical expressions."""

from __future__ import annotations

from math import cos, isfinite, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindex.functions.guards import no_nan

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def _rad(x: Column) -> Column:
    return x * F.lit(pi) / F.lit(180.0)


def _col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance; the haversine is clamped to [0, 1], so antipodes give no NaN."""
    a1, g1, a2, g2 = map(_col, (lat1, lng1, lat2, lng2))
    half_lat, half_lng = _rad(a2 - a1) / 2, _rad(g2 - g1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(_rad(a1)) * F.cos(_rad(a2)) * F.sin(half_lng) * F.sin(half_lng)
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def radius_boxes(lat: float, lng: float, km: float) -> list[tuple[float, float, float, float]]:
    """One or two boxes (min lat, max lat, min lng, max lng) around a circle: clamped at the poles, split at the antimeridian."""
    no_nan(lat, lng, km)
    up = km / KM_PER_DEGREE
    scale = KM_PER_DEGREE * cos(lat * pi / 180.0)
    side = km / scale if scale else float("inf")
    south, north = max(lat - up, -90.0), min(lat + up, 90.0)
    west, east = lng - side, lng + side
    if south <= -90.0 or north >= 90.0 or not isfinite(side) or not east - west < 360.0:
        return [(south, north, -180.0, 180.0)]
    if west < -180.0:
        return [(south, north, west + 360.0, 180.0), (south, north, -180.0, east)]
    if east > 180.0:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360.0)]
    return [(south, north, west, east)]


def box_area(south, west, north, east) -> Column:
    return (_col(north) - _col(south)) * (_col(east) - _col(west))


def box_union(a: tuple, b: tuple) -> tuple[Column, ...]:
    """The least box over two boxes given as (south, north, west, east)."""
    lo = [F.least(_col(a[k]), _col(b[k])) for k in (0, 2)]
    hi = [F.greatest(_col(a[k]), _col(b[k])) for k in (1, 3)]
    return lo[0], hi[0], lo[1], hi[1]


def boxes_meet(a: tuple, b: tuple) -> Column:
    """Closed boxes (south, north, west, east): touching counts."""
    return (_col(a[0]) <= _col(b[1])) & (_col(b[0]) <= _col(a[1])) & (_col(a[2]) <= _col(b[3])) & (_col(b[2]) <= _col(a[3]))


def in_box(lat: Column | str, lng: Column | str, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides; an inverted box holds nothing."""
    south, north, west, east = box
    return _col(lat).between(south, north) & _col(lng).between(west, east)
