"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, in the form with atan2."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def polyline_m(coords: Column) -> Column:
    """Length of an array of [lon, lat] arrays: the sum of its arcs."""
    arcs = F.zip_with(F.slice(coords, F.lit(1), F.size(coords) - 1), F.slice(coords, F.lit(2), F.size(coords) - 1), lambda a, b: haversine_m(a[1], a[0], b[1], b[0]))
    return F.when(F.size(coords) < 2, F.lit(0.0)).otherwise(F.aggregate(arcs, F.lit(0.0), lambda acc, x: acc + x))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def point_to_segment_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance from a point to a short straight segment, on a local plane."""
    k = F.cos(F.radians(lat1))
    ax, ay = (lon2 - lon1) * k, lat2 - lat1
    px, py = (lon - lon1) * k, lat - lat1
    norm = ax * ax + ay * ay
    t = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * ax + py * ay) / norm))).otherwise(F.lit(0.0))
    dx, dy = px - t * ax, py - t * ay
    return F.sqrt(dx * dx + dy * dy) * F.lit(EARTH_RADIUS_M * 3.141592653589793 / 180.0)
