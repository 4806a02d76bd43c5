"""Distances, extents and place names on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pacegrid.functions import fixed
from pacegrid.functions.text import blank_to_null, clean_text


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * fixed.EARTH_KM * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def extent_km(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Diagonal of a bounding box."""
    return F.hypot((north - south) * 111.0, (east - west) * 111.0 * F.cos(F.radians((north + south) / 2)))


def precise_enough(extent: Column, kind: Column) -> Column:
    """Whether a place is small enough to measure from: by extent, without one by its kind."""
    return F.when(extent.isNotNull(), extent <= fixed.MAX_EXTENT_KM).otherwise(F.coalesce(~kind.isin(*fixed.COARSE_TYPES), F.lit(True)))


def place_queries(city: Column, region: Column) -> Column:
    """Lookup texts, most specific first: ``city, region`` unless they are the same, then the city."""
    city, region = clean_text(city), clean_text(region)
    both = F.when(region.isNotNull() & (F.lower(region) != F.lower(city)), F.concat(city, F.lit(", "), region))
    return F.when(city.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.array(both, city), lambda x: x.isNotNull()))


def place_key(query: Column, country: Column) -> Column:
    """Cache key of a lookup: lower-cased text and two-letter country, if it is one."""
    code = F.when(F.regexp_like(country, F.lit(r"(?U)^\p{L}{2}$")), F.lower(country)).otherwise("")
    return F.concat(F.lower(query), F.lit("|"), F.coalesce(code, F.lit("")))


def located(latitude: Column, longitude: Column) -> Column:
    """Whether both coordinates are there."""
    return latitude.isNotNull() & longitude.isNotNull()


def distance_text(km: Column, approximate: Column) -> Column:
    """``<1 km``, one decimal below 10, else whole with separators; ``~`` in front if approximate; null without km."""
    text = F.when(km < 1, "<1 km").when(km < 10, F.format_string("%.1f km", km)).otherwise(F.concat(F.format_number(F.floor(km + 0.5).cast("double"), 0), F.lit(" km")))
    return F.when(km.isNotNull(), F.concat(F.when(approximate, "~").otherwise(""), text))


def short_place(label: Column) -> Column:
    """First three comma-separated parts of a place name."""
    return F.array_join(F.slice(F.transform(F.split(label, ","), lambda x: F.trim(x)), 1, 3), ", ")


def brand_city(title: Column) -> Column:
    """City in a branded title: what follows the last ``hyrox`` without punctuation and edition words; null without either."""
    tail = F.when(F.regexp_like(title, F.lit("(?i)hyrox")), F.regexp_extract(title, r"(?is)^.*hyrox(.*)$", 1))
    edge = r"[ \-|/,:–—]+"
    tail = F.trim(F.regexp_replace(F.regexp_replace(tail, f"^{edge}|{edge}$", ""), r"(?U)\s+", " "))
    return blank_to_null(F.regexp_replace(tail, r"(?iU)^(?:(?:youngstars|world championships?|championships?|elite 15)\s+)+", ""))
