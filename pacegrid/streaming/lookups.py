"""Places looked up as a stream: keys arrive in a folder, and the answers of each batch are committed as a whole.

A run that is killed asks again for its open batch only; answered keys are never asked for again. Keys that failed or
were passed over stand in the table, too, and join the next batch, up to a number of failures. How the service fared
(failures in a row, time of the last) is read from the committed batches, so its rest outlasts a restart.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pacegrid.functions import fixed
from pacegrid.operators import geocode

TRIES = f"{geocode.TRY}, tried_in long"
#: Failures of a key before it is given up.
MOST_FAILURES = 6


def tries(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """What each committed batch got for each of its keys, with the batch's number; those before a batch only, if given."""
    try:
        found = spark.read.schema(TRIES).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        found = spark.createDataFrame([], TRIES)
    return found.where(F.col("version") == fixed.CACHE_VERSION).where(F.lit(True) if before is None else F.col("tried_in") < before)


def states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(key, query, country, answered, failures, state): state is answered, failed (given up) or open."""
    is_ = lambda s: F.col("state") == s
    by_key = tries(spark, path, before).groupBy("key").agg(F.min("query").alias("query"), F.min("country").alias("country"), F.count_if(is_(geocode.ANSWERED)).alias("answered"), F.count_if(is_(geocode.FAILED)).alias("failures"))
    return by_key.withColumn("state", F.when(F.col("answered") > 0, geocode.ANSWERED).when(F.col("failures") >= MOST_FAILURES, geocode.FAILED).otherwise("open"))


def breaker(spark: SparkSession, path: str, before: int | None = None) -> geocode.Breaker:
    """How the service fared at the end of the committed batches."""
    at, known = F.struct("tried_in", "turn"), tries(spark, path, before)
    last = known.agg(F.max(F.when(F.col("state") == geocode.ANSWERED, at)).alias("last"))
    failed = known.where(F.col("state") == geocode.FAILED).join(F.broadcast(last), F.col("last").isNull() | (at > F.col("last")))  # one row
    row = failed.agg(F.count("*").alias("n"), F.max("asked_at").alias("at")).first()
    return geocode.Breaker(row["n"], row["at"] or 0.0)


def places(spark: SparkSession, path: str) -> DataFrame:
    """The answers as a table of places, a row a key."""
    answer = F.struct("query", "country", "latitude", "longitude", "found", "version")
    answers = tries(spark, path).where(F.col("state") == geocode.ANSWERED).groupBy("key").agg(F.max_by(answer, "tried_in").alias("answer"))
    return answers.select("key", "answer.*")


def look_up(keys: DataFrame, path: str, checkpoint: str, find: geocode.Finder, pause: float = fixed.LOOKUP_SECONDS, rest: float = fixed.RETRY_SECONDS) -> StreamingQuery:
    """Asks for what the stream ``keys`` (key, query, country) brings, batch by batch (the source's own limits say how large one
    is), into the table at ``path``. Null keys are left out; a key that a batch names twice is asked for once."""

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = states(spark, path, number)
        waiting = known.where("state = 'open'").select("key", "query", "country")
        fresh = batch.select("key", "query", "country").where("key is not null").join(known.select("key"), "key", "left_anti")
        due = fresh.unionByName(waiting).groupBy("key").agg(F.min("query").alias("query"), F.min("country").alias("country"))
        found = geocode.attempts(due, find, pause, rest, breaker(spark, path, number))
        found.withColumn("tried_in", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return keys.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
