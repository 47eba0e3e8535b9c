"""Coordinates as texts, and distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8

_DECIMAL = r"^([+\-−]?)(\d+(?:[.,]\d+)?)\s*°?\s*([NSEWnsew]?)$"
_SEXAGESIMAL = r"""^([+\-−]?)(\d+)\s*(?:deg|°)\s*(\d+(?:[.,]\d+)?)\s*['′]\s*(?:(\d+(?:[.,]\d+)?)\s*(?:"|″|'')\s*)?([NSEWnsew]?)$"""


def degrees(text: Column) -> Column:
    """Signed degrees of a coordinate text, decimal or with minutes and seconds, with sign or hemisphere; null for anything else."""
    text = F.trim(text)
    number = lambda form, k: F.regexp_replace(F.regexp_extract(text, form, k), ",", ".").try_cast("double")
    back = lambda form, k: F.when(F.regexp_extract(text, form, 1).isin("-", "−") != F.upper(F.regexp_extract(text, form, k)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(text.rlike(_DECIMAL), back(_DECIMAL, 3) * number(_DECIMAL, 2)).when(
        text.rlike(_SEXAGESIMAL), back(_SEXAGESIMAL, 5) * (number(_SEXAGESIMAL, 2) + number(_SEXAGESIMAL, 3) / 60 + F.coalesce(number(_SEXAGESIMAL, 4), F.lit(0.0)) / 3600)
    )


def positions(df, latitude: str, longitude: str, lat: str = "lat", lon: str = "lon"):
    """df's rows with a usable position, in the new columns lat and lon: both parts read, in range, and not 0/0."""
    # inline keeps the optimiser from repeating the parsing in every use of the two columns.
    read = df.select("*", F.inline(F.array(F.struct(degrees(F.col(latitude)).alias(lat), degrees(F.col(longitude)).alias(lon)))))
    return read.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~((F.col(lat) == 0) & (F.col(lon) == 0)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) ** 2
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
