"""A crawl frontier as a stream: links arrive in a folder, and every batch of them is fetched and committed as a whole.

What a batch fetched stands in its own folder, which a repeated batch replaces; so a run that is killed
fetches its open batch again and nothing else. A link is fetched by the first batch that it comes in; one that
failed is tried by later batches that name it again, up to a number of attempts. Hosts keep their pace: within a
batch one task owns a host, and batches follow each other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pacegrid.operators.relational import first_per_key
from pacegrid.sources import web

TRIES = f"{web.SCHEMA}, tried_in long"
#: Requests that a link gets in all before it is given up.
MOST_ATTEMPTS = 6


def tries(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All rows of the frontier at ``path``: what each committed batch got for each of its links, with the batch's number."""
    try:
        found = spark.read.schema(TRIES).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], TRIES)
    return found if before is None else found.where(F.col("tried_in") < before)


def _final() -> Column:
    """Answers that no further request would change, and links that robots.txt forbids."""
    return F.coalesce(F.col("status").between(200, 499), F.lit(False)) | (F.col("attempts") == 0)


def states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """A row a link: attempts in all, tries (batches), the last try's status and error, and state (done, failed, open)."""
    known = tries(spark, path, before).groupBy("url").agg(F.sum("attempts").cast("long").alias("attempts"), F.count("*").alias("tries"), F.max_by(F.struct("status", "error", _final().alias("final")), "tried_in").alias("last"))
    state = F.when(F.col("last.final"), F.when(F.col("last.status") == 200, "done").otherwise("failed")).when(F.col("attempts") >= MOST_ATTEMPTS, "failed").otherwise("open")
    return known.select("url", "attempts", "tries", "last.status", "last.error", state.alias("state"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, status, html, error) of the last try of each link, as the crawl takes them."""
    return first_per_key(tries(spark, path), ["url"], [F.desc("tried_in")]).select("url", "status", "html", "error")


def requests_made(spark: SparkSession, path: str) -> DataFrame:
    """One row: requests for pages, repeats among them."""
    return tries(spark, path).agg(F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("requests_made"))


def fetch(links: DataFrame, path: str, checkpoint: str, options: dict | None = None, tasks: int | None = None) -> StreamingQuery:
    """Fetches what the stream ``links`` (url) brings, batch by batch (the source's own limits say how large one is), into
    the frontier at ``path``. Options are those of the ``pages`` source. Only links that are new or still open are fetched."""

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        settled = states(spark, path, number).where("state <> 'open'").select("url")
        due = batch.select("url").where("url is not null").distinct().join(settled, "url", "left_anti")
        # the folder's name is no column: a batch's number stands in its rows
        web.fetched(due, options, tasks).withColumn("tried_in", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return links.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
