"""The event record. Fixed names and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_DDL = (
    "title string, source string, source_url string, id string, description string, start string, end string, date_status string, sport string, "
    "distances array<string>, distance_km array<double>, event_subtypes array<string>, is_online boolean, venue_name string, address string, city string, region string, country string, "
    "latitude double, longitude double, coords_source string, price_min double, price_max double, currency string, ticket_url string, found_on_url string, image_url string, "
    "organizer string, status string, scraped_at string"
)


def as_events(df: DataFrame) -> DataFrame:
    """``df`` with exactly the record's columns, missing ones null."""
    fields = [x.strip().split(" ", 1) for x in EVENT_DDL.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
