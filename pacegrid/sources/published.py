"""Sinks whose tables change together: versions in folders of their own behind one pointer file.

A version is written whole under a new name; then the pointer is replaced by a rename, the only step that
readers see. Whatever fails before leaves the last version as it was, and readers that began with it keep reading it
until it is more than ``keep`` versions old.
"""

from __future__ import annotations

import time
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacegrid.operators import crawl as crawls
from pacegrid.operators import geocode
from pacegrid.operators.lineage import written

POINTER, VERSIONS = "CURRENT", "versions"


def _path(spark: SparkSession, *parts: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, folder: str) -> JavaObject:
    return _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[str]:
    """All versions in the folder, finished or not, oldest first: their names begin with the time."""
    files, top = _files(spark, folder), _path(spark, folder, VERSIONS)
    return sorted(x.getPath().getName() for x in files.listStatus(top)) if files.exists(top) else []


def current(spark: SparkSession, folder: str) -> str | None:
    """The name of the version that readers get; null before the first."""
    pointer = _path(spark, folder, POINTER)
    return spark.read.text(pointer.toString()).first()["value"] if _files(spark, folder).exists(pointer) else None


def publish(tables: dict[str, DataFrame], folder: str, keep: int = 2) -> str:
    """Writes ``tables`` as the next version and makes it the current one; the name of the version.

    They may be read from the current version itself. Of older versions ``keep`` stay, unfinished ones counted; none that
    began later is touched. If two runs publish at a time, the last rename wins, each with all of its tables.
    """
    spark = next(iter(tables.values())).sparkSession
    files, before = _files(spark, folder), versions(spark, folder)
    name = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for table, df in tables.items():
        df.write.mode("error").parquet(f"{folder}/{VERSIONS}/{name}/{table}")
    draft = _path(spark, folder, f".{name}")
    out = files.create(draft, True)
    out.write(bytearray(f"{name}\n".encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark._sc._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(_path(spark, folder, POINTER)), overwrite)
    for old in before[: max(0, len(before) - keep)]:
        files.delete(_path(spark, folder, VERSIONS, old), True)
    return name


def published(spark: SparkSession, folder: str, table: str, version: str | None = None) -> DataFrame | None:
    """A table of the current, or a given, version; null before the first."""
    version = version or current(spark, folder)
    return spark.read.parquet(f"{folder}/{VERSIONS}/{version}/{table}") if version else None


def save_crawl(ran: crawls.Crawl, folder: str, run_at: str, keep: int = 2) -> str:
    """Publishes a run's events, in order, its site results and its report, stamped with the time of the run."""
    report = ran.report.withColumn("run_at", F.lit(run_at))
    return publish({"events": ran.events, "sites": ran.sites, "report": report}, folder, keep)


def save_verdicts(verdicts: DataFrame, folder: str) -> str:
    """Publishes verdicts() of pages."""
    return publish({"verdicts": verdicts}, folder)


def save_places(spark: SparkSession, folder: str, keys: DataFrame, find: geocode.Finder, **pace: float) -> DataFrame:
    """Looks up what the published places lack, publishes them with the answers, and returns them all."""
    known = published(spark, folder, "places")
    places = written(geocode.look_up(keys, spark.createDataFrame([], geocode.PLACE) if known is None else known, find, **pace))
    publish({"places": places}, folder)
    return published(spark, folder, "places")


def annotate_published(spark: SparkSession, folder: str, places: DataFrame) -> str | None:
    """Gives coordinates to the published events without a new crawl; events and the report's counts change together, the
    rest of the report and the sites stay. Null where nothing is published."""
    version = current(spark, folder)
    if version is None:
        return None
    events, sites, report = (published(spark, folder, table, version) for table in ("events", "sites", "report"))
    annotated = written(geocode.annotate(events, places))
    counts = geocode.coordinate_counts(annotated)
    stamped = report.drop("geocoded", "without_coords").join(F.broadcast(counts)).select(*report.columns)
    ordered = annotated.orderBy(*crawls.event_order(), "source_url")
    return publish({"events": ordered, "sites": sites, "report": stamped}, folder)
