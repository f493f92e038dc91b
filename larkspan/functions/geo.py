"""Distances and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres; null if any coordinate is."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_box(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """A bounding box around a point: comparisons with literals, which reach the scan. It holds all points within km."""
    from math import asin, cos, degrees, radians, sin

    half = degrees(km / EARTH_KM) * 1.001
    reach = abs(at_lat) + half
    in_lat = lat.between(at_lat - half, at_lat + half)
    if reach >= 89.0:
        return in_lat
    wide = degrees(asin(min(1.0, sin(radians(half)) / cos(radians(at_lat)))))
    if at_lng - wide < -180 or at_lng + wide > 180:
        return in_lat
    return in_lat & lng.between(at_lng - wide, at_lng + wide)


def valid_coordinates(lat: Column, lng: Column) -> Column:
    """Within range, and not the null island at (0, 0)."""
    ok = lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0) & ~((lat == 0) & (lng == 0))
    return F.coalesce(ok, F.lit(False))


def needs_location(lat: Column, lng: Column) -> Column:
    return lat.isNull() | lng.isNull() | ((lat == 0) & (lng == 0))


def parse_point(text: Column) -> Column:
    """struct<lat, lng> of `POINT(lng lat)` or GeoJSON text; null for anything else."""
    number = r"(-?\d+(?:\.\d+)?)"
    wkt = rf"(?i)^\s*(?:SRID=\d+;)?\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    geo = rf'"coordinates"\s*:\s*\[\s*{number}\s*,\s*{number}'
    x = F.coalesce(F.nullif(F.regexp_extract(text, wkt, 1), F.lit("")), F.nullif(F.regexp_extract(text, geo, 1), F.lit("")))
    y = F.coalesce(F.nullif(F.regexp_extract(text, wkt, 2), F.lit("")), F.nullif(F.regexp_extract(text, geo, 2), F.lit("")))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lng")))


def _double_of_hex(text: Column) -> Column:
    """A little-endian IEEE 754 double written as 16 hexadecimal digits, for finite normal numbers and zero."""
    swapped = F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(8)])
    high = F.conv(F.substring(swapped, 1, 3), 16, 10).cast("int")
    exponent = high.bitwiseAND(F.lit(0x7FF))
    fraction = F.conv(F.substring(swapped, 4, 13), 16, 10).cast("long").cast("double") / F.lit(2.0**52)
    value = (F.lit(1.0) + fraction) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    return F.when(exponent == 0, F.lit(0.0)).otherwise(F.when(high >= 0x800, -value).otherwise(value))


def parse_ewkb(text: Column) -> Column:
    """struct<lat, lng> of a little-endian EWKB point in hexadecimal, with a reference system or without."""
    with_srid = text.rlike("^(?i)0101000020[0-9a-f]{40}$")
    plain = text.rlike("^(?i)0101000000[0-9a-f]{32}$")
    x = F.when(with_srid, F.substring(text, 19, 16)).when(plain, F.substring(text, 11, 16))
    y = F.when(with_srid, F.substring(text, 35, 16)).when(plain, F.substring(text, 27, 16))
    return F.when(x.isNotNull(), F.struct(_double_of_hex(y).alias("lat"), _double_of_hex(x).alias("lng")))


def distance_label(km: Column) -> Column:
    """`right here` within 100 m, metres by fifties below a kilometre, else kilometres with one decimal."""
    metres = (F.round(km * 1000 / 50) * 50).cast("int").cast("string")
    return F.when(km < 0.1, "right here").when(km < 1, F.concat(metres, F.lit("m away"))).otherwise(F.format_string("%.1fkm away", km))


def walking_label(km: Column) -> Column:
    minutes = walking_minutes(km)
    return F.when(minutes < 1, "< 1 min walk").when(minutes > 60, F.concat(F.round(minutes / 60).cast("int").cast("string"), F.lit("h walk"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min walk")))


def walking_minutes(km: Column) -> Column:
    return F.round(km * 12).cast("int")
