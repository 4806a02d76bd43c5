"""Lineage cuts of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. A private folder is set only where a local session has
    none; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return f"{context.getCheckpointDir()}/round-{uuid.uuid4().hex}"


#: Rows that a part of a small table is dealt, where the work on each row is heavy.
DEALT_ROWS = 25_000


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` in parts of about ``rows`` rows (DEALT_ROWS if none are given), but at most four for each core. A table of short rows is one file of few
    row groups, which few tasks would read, however heavy the work on its rows; tables with parts enough stay as they are."""
    parts = min(-(-df.count() // (rows or DEALT_ROWS)), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
