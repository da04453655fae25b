"""Distances on the sphere and straight-line travel times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: km/h by mode and the detour factor of straight-line estimates: fixed values.
SPEEDS = {"drive": 28.0, "bike": 14.0, "foot": 4.5}
DETOUR = 1.3


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def straight_minutes(km: Column, mode: str, detour: float = DETOUR) -> Column:
    """Whole minutes, at least 1."""
    return F.greatest(F.floor(km * F.lit(detour * 60 / SPEEDS[mode]) + 0.5), F.lit(1)).cast("int")


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float, margin_km: float = 0.0) -> Column:
    """Inside a box grown by a margin."""
    import math

    dlat = math.degrees(margin_km / EARTH_KM)
    dlon = dlat / max(0.01, math.cos(math.radians((south + north) / 2)))
    return lat.between(south - dlat, north + dlat) & lon.between(west - dlon, east + dlon)
