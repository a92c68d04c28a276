"""Geodesics on the sphere as column expressions; points are degrees of longitude and latitude."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dist_deg(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in degrees by half-angle sines, exact for near points."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat, half_lon = F.sin((a - b) / 2), F.sin((F.radians(_c(lon1)) - F.radians(_c(lon2))) / 2)
    chord = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon
    return F.degrees(2 * F.asin(F.sqrt(clamp(chord, 0.0))))


def dist_deg_acos(lon1, lat1, lon2, lat2) -> Column:
    """The same by the law of cosines, clamped so that coinciding points give 0 and not NaN."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    return F.degrees(F.acos(clamp(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(_c(lon1)) - F.radians(_c(lon2))))))


def deg_to_km(deg) -> Column:
    return F.radians(_c(deg)) * EARTH_RADIUS_KM


def dist_km(lon1, lat1, lon2, lat2) -> Column:
    return deg_to_km(dist_deg(lon1, lat1, lon2, lat2))


def degdiff(a, b) -> Column:
    """b - a as an angle in (-180, 180]."""
    d = F.pmod(_c(b) - _c(a), F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def azimuth(lon1, lat1, lon2, lat2) -> Column:
    """Direction from the first point to the second, clockwise from north, in [0, 360)."""
    a, b, step = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2)) - F.radians(_c(lon1))
    sine = F.sin(F.radians(dist_deg(lon1, lat1, lon2, lat2)))
    angle = F.degrees(F.acos(clamp(F.try_divide(F.sin(b) * F.cos(a) - F.cos(b) * F.sin(a) * F.cos(step), sine))))
    return F.when(F.sin(step) >= 0, angle).otherwise(360 - angle)


def destination(lon, lat, azi, km) -> tuple[Column, Column]:
    """Longitude and latitude of the point at an azimuth and a distance."""
    a, w, d = F.radians(_c(lat)), F.radians(_c(azi)), _c(km) / EARTH_RADIUS_KM
    sine = F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(w)
    out_lat = F.asin(clamp(sine))
    turn = F.atan2(F.sin(w) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(out_lat))
    return wrap_lon(_c(lon) + F.degrees(turn)), F.degrees(out_lat)


def wrap_lon(lon) -> Column:
    """Longitude in [-180, 180). What lies before the date line by less than half the last bit of 720 is on it, so that it doesn't round to 180, and what lies that little before zero is zero."""
    return F.pmod(F.pmod(_c(lon) + 180, F.lit(360.0)) + 360, F.lit(360.0)) - 180


def lonlat_text(lon, lat) -> Column:
    """As in "12.30 W 45.00 N"."""
    side = lambda x, plus, minus: F.concat(F.format_string("%.2f", F.abs(x)), F.when(x < 0, minus).otherwise(plus))
    return F.concat(side(_c(lon), " E ", " W "), side(_c(lat), " N", " S"))


def in_box(lon, lat, left: float, right: float, bottom: float, top: float, strict: bool = False) -> Column:
    """In a box of degrees; one whose left side is east of its right side spans the date line."""
    lon, lat = _c(lon), _c(lat)
    if strict:
        inside = [lat > bottom, lat < top, (lon > left) & (lon < right) if left <= right else (lon > left) | (lon < right)]
    else:
        inside = [lat >= bottom, lat <= top, (lon >= left) & (lon <= right) if left <= right else (lon >= left) | (lon <= right)]
    return reduce(Column.__and__, inside)
