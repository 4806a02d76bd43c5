"""Faceted, full-text and radius search over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.functions.geo import haversine_km, located

SEARCHED = ("title", "city", "venue_name", "region", "country")


def result_order(near: bool) -> list[Column]:
    """Order of found rows: nearest first, unknown last, if there is an origin; then by start, undated last, then title."""
    start = F.coalesce("start", F.lit(""))
    return ([F.col("km").asc_nulls_last()] if near else []) + [start == "", start, F.lower("title")]


def search(df: DataFrame, sport: str | None = None, source: str | None = None, dated: bool = False, term: str | None = None, origin: tuple[float, float] | None = None, radius_km: float | None = None) -> DataFrame:
    """Events that meet all given conditions, with ``km`` from ``origin`` (null without one).

    ``term`` is looked for in lower case in title, place fields and distances, a missing part counting
    as empty. A radius hides rows without coordinates, and counts for nothing without an origin. With an
    origin rows come nearest first, unknown last; else by start, undated last, then title.
    """
    if sport:
        df = df.where(F.col("sport") == sport)
    if source:
        df = df.where(F.col("source") == source)
    if dated:
        df = df.where(F.coalesce("start", F.lit("")) != "")
    if term:
        parts = [F.coalesce(F.col(c), F.lit("")) for c in SEARCHED] + [F.coalesce(F.array_join("distances", " "), F.lit(""))]
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(term.lower())))
    km = F.lit(None).cast("double")
    if origin:
        km = F.when(located(F.col("latitude"), F.col("longitude")), haversine_km(F.lit(origin[0]), F.lit(origin[1]), F.col("latitude"), F.col("longitude")))
    df = df.withColumn("km", km)
    if origin and radius_km is not None:
        df = df.where(F.col("km") <= radius_km)
    return df.orderBy(*result_order(origin is not None))
