"""Geographic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
#: Metres in a degree of latitude, and in one of longitude at the equator.
LATITUDE_M, LONGITUDE_M = 110540.0, 111320.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points given in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(POW(SIN(RADIANS({lat2} - {lat1}) / 2), 2) + COS(RADIANS({lat1})) * COS(RADIANS({lat2})) * POW(SIN(RADIANS({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {EARTH_RADIUS_KM} * ATAN2(SQRT({h}), SQRT(GREATEST(0.0, 1 - {h}))))"


def node_id(longitude: Column, latitude: Column) -> Column:
    """The name of a road point: both coordinates with seven decimals, `m` for minus and `_` for the point."""
    name = lambda c: F.replace(F.replace(F.format_string("%.7f", c), F.lit("-"), F.lit("m")), F.lit("."), F.lit("_"))
    return F.concat(F.lit("road_"), name(latitude), F.lit("_"), name(longitude))


def padding_degrees(buffer_m: float, latitude: Column) -> tuple[Column, Column]:
    """Degrees of latitude and of longitude that a distance spans at a latitude."""
    return F.lit(buffer_m / LATITUDE_M), buffer_m / (LONGITUDE_M * F.cos(F.radians(latitude)))
