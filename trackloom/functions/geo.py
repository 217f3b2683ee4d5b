"""Distances, speeds and local flat coordinates as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from trackloom import constants as C


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in meters."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * C.EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


@F.pandas_udf(T.DoubleType())
def libm_haversine_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Great-circle distance in meters to the last digit, by the steps and the C library that SQL uses.

    Another order of the products often differs in that digit, Java's cosines now and then; it decides between
    places that are equally far but for rounding. Only for few rows, and only for positions that are known.
    """
    def meters(p, lon_p, q, lon_q):
        a, b = math.radians(p), math.radians(q)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon_q - lon_p) / 2) ** 2
        return 2 * C.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))

    return pd.Series(list(map(meters, lat1, lon1, lat2, lon2)), dtype=float)


def implied_speed_kmh(distance_m: Column, duration_s: Column) -> Column:
    """Speed needed for a distance; without any time it is infinite (or 0 for no distance)."""
    return F.when(
        duration_s <= 0,
        F.when(distance_m > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)),
    ).otherwise(distance_m / duration_s * 3.6)


def east_m(origin_lat: Column, origin_lon: Column, lon: Column) -> Column:
    """Meters east of an origin, on a local flat map."""
    return (lon - origin_lon) * C.METERS_PER_DEGREE * F.cos(F.radians(origin_lat))


def north_m(origin_lat: Column, lat: Column) -> Column:
    """Meters north of an origin, on a local flat map."""
    return (lat - origin_lat) * C.METERS_PER_DEGREE


def to_local_meters(origin_lat, origin_lon, lat, lon) -> Column:
    """Struct of meters east and north of an origin."""
    return F.struct(
        east_m(origin_lat, origin_lon, lon).alias("east_m"),
        north_m(origin_lat, lat).alias("north_m"),
    )


def measure_segment(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """Distance of the origin to a segment, and the unit direction (null for no length)."""
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / squared))
    has_length = squared > 0
    distance = F.when(has_length, F.hypot(x1 + fraction * dx, y1 + fraction * dy)).otherwise(
        F.hypot(x1, y1)
    )
    length = F.sqrt(squared)
    return distance, F.when(has_length, dx / length), F.when(has_length, dy / length)


def cell(value: Column, size: float) -> Column:
    """Grid row or column of a coordinate."""
    return F.floor(value / F.lit(size)).cast("long")


def on_globe(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same place with a latitude from -90 to 90 and a longitude from -180 to 180."""
    beyond = F.cos(F.radians(lat)) < 0
    turned = lon + F.when(beyond, 180.0).otherwise(0.0)
    return (
        F.when(lat.between(-90, 90), lat).otherwise(F.degrees(F.asin(F.sin(F.radians(lat))))),
        F.when(lat.between(-90, 90) & lon.between(-180, 180), lon).otherwise(turned - 360 * F.floor((turned + 180) / 360)),
    )


def lat_margin_deg(radius_m: float) -> float:
    """Degrees of latitude that cover a radius."""
    return radius_m / C.METERS_PER_DEGREE


def lon_margin_deg(radius_m: float, lat: Column) -> Column:
    """Degrees of longitude that cover a radius at a latitude."""
    return F.lit(lat_margin_deg(radius_m)) / F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
