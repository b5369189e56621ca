"""Coordinates, distances and walking times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway import constants as C


def with_cartesian(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with x, y, z metres on the sphere; zeros where a coordinate is null or not finite."""
    phi, lam = F.radians(lat), F.radians(lon)
    bad = F.col(lat).isNull() | F.col(lon).isNull() | F.isnan(F.col(lat) + F.col(lon)) | (F.abs(F.col(lat) + F.col(lon)) == float("inf"))
    r = F.lit(C.EARTH_RADIUS_M)
    xyz = {"x": r * F.cos(phi) * F.sin(lam), "y": r * F.cos(phi) * F.cos(lam), "z": r * F.sin(phi)}
    return df.withColumns({k: F.when(bad, F.lit(0.0)).otherwise(v) for k, v in xyz.items()})


def lat_of(z: Column) -> Column:
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / F.lit(C.EARTH_RADIUS_M)))))


def lon_of(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(x, y))


def chord(a: str, b: str) -> Column:
    """Straight-line metres between the points in columns ax, ay, az and bx, by, bz (a and b are prefixes), to a millionth: what decisions are made of."""
    dx, dy, dz = (F.col(a + c) - F.col(b + c) for c in "xyz")
    return F.round(F.sqrt(dx * dx + dy * dy + dz * dz), 6)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere (haversine)."""
    h = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.round(2 * C.EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h))), 6)


def access_seconds(metres: Column) -> Column:
    return F.floor(metres * F.lit(C.ACCESS_S_PER_M)).cast("bigint")


def walk_seconds(metres: Column) -> Column:
    """Whole millimetres at the transfer walking speed."""
    return F.floor(F.floor(metres * F.lit(1000.0)) / F.lit(C.WALK_MM_PER_S)).cast("bigint")
