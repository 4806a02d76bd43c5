"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacegrid.llm import decontam, mixing, near_dedup, quality, sharding
from pacegrid.llm.common import cut, table
from pacegrid.llm.queries import MIX_WEIGHTS, SHARD_BYTES


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like others; equal texts share their fate."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group (similarity 0.8 or more). It goes by texts, so null and
    repeated ids with different texts all stay; rows equal in id and text count once. Null texts and those without words all stay."""
    return near_dedup.one_of_each(docs, 80, 100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts stay; equal texts share their fate, repeated rows all stay or all go."""
    return decontam.mark_contaminated(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: the sources follow their weights as long as all of them last. Rows of no source or one
    without a weight come last; repeated rows all stay, next to each other in their source's order."""
    slots = mixing.mix_sources(docs, MIX_WEIGHTS)
    order = [F.col("mix_slot").asc_nulls_last(), F.col("mix_place"), F.col("doc_id")]
    return slots.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in the mix, each shard in one piece and in that order.

    mix_slot and mix_place are those of mixed(), as they depend on ids and sources only; shard_place numbers
    the rows of a shard by them. Null texts have no bytes; rows equal in id and text fill pages of a shard where they exceed its limit.
    """
    name = ["shard_bits", "shard_prefix", "shard_page"]
    order = [F.col("mix_slot").asc_nulls_last(), F.col("mix_place"), F.col("doc_id")]
    placed = sharding.shard(mixing.mix_sources(docs, MIX_WEIGHTS), SHARD_BYTES).drop("mix_block")
    return placed.withColumn("shard_place", (F.row_number().over(Window.partitionBy(*name).orderBy(*order)) - 1).cast("long")).sortWithinPartitions(*name, "shard_place")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("near-duplicate removal", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("source mixing", mixed),
    ("sharding", sharded),
]
#: Ridge scores, sketches and slot runs can't be expressed in SQL. Near-duplicates, mixing and sharding are tested against brute
#: force, decontamination against a brute force by words and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written once to the shared folder and read again by the next; the result has their columns, n_bytes, the shard of each row and its place in the mix and in the shard."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
