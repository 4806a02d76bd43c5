"""Coordinates from a table of known places.

Only place texts that the table lacks are looked up, each once, by one task that keeps the service's
pace. After several failures in a row it makes no requests for a while. Failures are not stored; places not found
are, as null, with the version of the rules that they were judged by: rows of other versions don't count.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.functions import fixed, geo

PLACE = "key string, query string, country string, latitude double, longitude double, found boolean, version int"
#: A finder takes (query, country code or empty) and returns (latitude, longitude, extent in km or None, kind) or None.
Finder = Callable[[str, str], tuple[float, float, float | None, str] | None]


def place_keys(events: DataFrame) -> DataFrame:
    """(id, rank, key, query, country) of all events without coordinates, the most specific first."""
    open_rows = events.where(~geo.located(F.col("latitude"), F.col("longitude")))
    each = open_rows.select("id", "country", F.posexplode(geo.place_queries(F.col("city"), F.col("region"))).alias("rank", "query"))
    return each.select("id", "rank", geo.place_key(F.col("query"), F.col("country")).alias("key"), "query", F.coalesce("country", F.lit("")).alias("country"))


#: What came of a key: answered, failed, or passed over while the service was left alone.
ANSWERED, FAILED, PASSED = "answered", "failed", "passed"
TRY = f"{PLACE}, state string, asked_at double, turn long"
_ARROW = pa.schema([("key", pa.string()), ("query", pa.string()), ("country", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64()), ("found", pa.bool_()), ("version", pa.int32()), ("state", pa.string()), ("asked_at", pa.float64()), ("turn", pa.int64())])


class Breaker(NamedTuple):
    """Failures in a row so far, and the time of the last one."""

    failures: int = 0
    failed_at: float = 0.0


def asked(batches: Iterator[pa.RecordBatch], find: Finder, pause: float, rest: float, breaker: Breaker = Breaker(), clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Iterator[pa.RecordBatch]:
    """A row (TRY) for each key in turn. After MAX_FAILURES failures in a row keys are passed over until ``rest`` seconds are gone."""
    failures, failed_at = breaker
    turn = 0
    for batch in batches:
        out = []
        for x in batch.select(["key", "query", "country"]).to_pylist():
            row = x | {"latitude": None, "longitude": None, "found": None, "version": fixed.CACHE_VERSION, "asked_at": clock(), "turn": turn}
            turn += 1
            if failures >= fixed.MAX_FAILURES and clock() - failed_at <= rest:
                out.append(row | {"state": PASSED})
                continue
            try:
                hit = find(x["query"], x["country"])
                failures = 0
            except OSError:
                failures, failed_at = failures + 1, clock()
                out.append(row | {"state": FAILED, "asked_at": failed_at})
                continue
            finally:
                sleep(pause)
            if hit and not (hit[2] <= fixed.MAX_EXTENT_KM if hit[2] is not None else hit[3] not in fixed.COARSE_TYPES):
                hit = None
            out.append(row | {"latitude": round(hit[0], 6) if hit else None, "longitude": round(hit[1], 6) if hit else None, "found": hit is not None, "state": ANSWERED})
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def attempts(new: DataFrame, find: Finder, pause: float = fixed.LOOKUP_SECONDS, rest: float = fixed.RETRY_SECONDS, breaker: Breaker = Breaker()) -> DataFrame:
    """(TRY) of distinct keys (key, query, country), in order of keys. They go to one task: a service's pace is kept in one place."""
    return new.select("key", "query", "country").repartition(1).sortWithinPartitions("key").mapInArrow(lambda batches: asked(batches, find, pause, rest, breaker), TRY)


def look_up(keys: DataFrame, places: DataFrame, find: Finder, pause: float = fixed.LOOKUP_SECONDS, rest: float = fixed.RETRY_SECONDS) -> DataFrame:
    """``places`` of the present version with the answers for keys that it lacks. What failed or was passed over is not
    stored and comes up again in the next run; streaming.lookups commits the answers in batches."""
    places = places.where(F.col("version") == fixed.CACHE_VERSION)
    new = keys.join(places.select("key"), "key", "left_anti").groupBy("key").agg(F.min("query").alias("query"), F.min("country").alias("country"))
    return places.unionByName(attempts(new, find, pause, rest).where(F.col("state") == ANSWERED).drop("state", "asked_at", "turn"))


def annotate(events: DataFrame, places: DataFrame) -> DataFrame:
    """``events`` with coordinates of the first of their keys that is a found place. Listed coordinates stay
    and are marked ``listing`` where unmarked; new ones are marked ``geocoded``."""
    hits = place_keys(events).join(places.where(F.col("found") & (F.col("version") == fixed.CACHE_VERSION)).select("key", "latitude", "longitude"), "key")
    best = hits.groupBy("id").agg(F.min_by(F.struct("latitude", "longitude"), "rank").alias("hit"))
    had = geo.located(F.col("latitude"), F.col("longitude"))
    joined = events.join(best, "id", "left")
    marked = F.when(had, F.coalesce("coords_source", F.lit("listing"))).when(F.col("hit").isNotNull(), "geocoded").otherwise(F.col("coords_source"))
    return joined.withColumns({"coords_source": marked, "latitude": F.when(had | F.col("hit").isNull(), F.col("latitude")).otherwise(F.col("hit.latitude")), "longitude": F.when(had | F.col("hit").isNull(), F.col("longitude")).otherwise(F.col("hit.longitude"))}).select(*events.columns)


def coordinate_counts(events: DataFrame) -> DataFrame:
    """One row: geocoded (rows whose coordinates were looked up) and without_coords."""
    return events.agg(F.count_if(F.coalesce(F.col("coords_source") == "geocoded", F.lit(False))).alias("geocoded"), F.count_if(~geo.located(F.col("latitude"), F.col("longitude"))).alias("without_coords"))
