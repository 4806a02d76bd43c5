"""Snapshots of events, and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from pacegrid.operators.lineage import written
from pacegrid.schema import EVENT_DDL, as_events


def read_snapshot(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Events of a snapshot: a JSON array, JSON lines or Parquet. A missing path gives no rows; unknown
    fields are left out, unreadable records dropped."""
    reader = spark.read.schema(EVENT_DDL)
    try:
        if format != "json":
            return as_events(reader.format(format).load(path))
        # lines can be split among tasks; only an array that goes over several lines must be read as one
        first = spark.read.text(path).where("trim(value) <> ''").first()
        return as_events(reader.option("multiLine", first is not None and first["value"].lstrip().startswith("[")).option("mode", "DROPMALFORMED").json(path))
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], EVENT_DDL)


def write_snapshot(events: DataFrame, path: str, format: str = "parquet") -> None:
    """Replaces the snapshot at ``path``; JSON keeps null fields. Not for a path that ``events`` reads."""
    writer = as_events(events).write.mode("overwrite")
    writer.option("ignoreNullFields", False).json(path) if format == "json" else writer.format(format).save(path)


def replace_snapshot(events: DataFrame, path: str, format: str = "parquet") -> None:
    """write_snapshot() for ``events`` that were read from ``path`` itself: they are written to the shared folder first."""
    write_snapshot(written(as_events(events)), path, format)
