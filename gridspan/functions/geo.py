"""Spherical geometry as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def signed_longitude_difference(a: Column, b: Column) -> Column:
    """a - b wrapped to [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance; null where any coordinate is null."""
    dlon, dlat = F.radians(signed_longitude_difference(lon2, lon1)), F.radians(lat2 - lat1)
    h = F.sin(dlat / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) ** 2
    # greatest and least skip nulls, so nulls are kept out of them
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))))


def centroid(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(longitude in [0, 360), latitude) of a summed vector."""
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.atan2(z, F.hypot(x, y)))


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null: NaN and infinity never reach a comparison or a mean."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
