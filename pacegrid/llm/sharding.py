"""Sharding by extendible hashing.

A document's key is the first ``KEY_BITS`` bits of an MD5 of its id and text. The directory starts
with one bucket; a bucket above the byte limit splits on one more bit, others stay as they are.
A bucket's bytes only shrink as bits are added, so a key's bucket is the shortest prefix whose
bytes fit, and the byte sums of all prefixes are enough to find it: sums are taken once for prefixes
of ``depth`` bits, rolled up to the shorter ones, and taken again with more bits only inside the
prefixes that are still too large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm.common import cut

KEY_BITS = 60
#: Bits beyond the expected depth that one pass over the keys counts, and those of later passes.
SPARE_BITS, MORE_BITS = 4, 8
#: A directory of up to so many entries (about 40 bytes each) is broadcast to the rows, a larger one is joined by shuffle.
BROADCAST_ENTRIES = 200_000


def shard_key() -> Column:
    """The hash of a row: 60 bits as a long."""
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _directory(keys: DataFrame, floor_bits: int, depth: int, limit: int) -> DataFrame:
    """(cell, bits, prefix, alone): for each cell of ``depth`` bits its bucket among those of more than
    ``floor_bits`` bits; bits is null where even the cell is too large. alone: one key only."""
    cells = keys.groupBy(F.shiftright("key", KEY_BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
    levels = cells.withColumn("bits", F.explode(F.sequence(F.lit(floor_bits), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - bits)"))
    sums = levels.groupBy("bits", "prefix").agg(F.sum("n_bytes").alias("n_bytes"), (F.min("low") == F.max("high")).alias("alone"))
    fits = sums.where((F.col("n_bytes") <= limit) | F.col("alone")).select("bits", "prefix", (F.col("n_bytes") > limit).alias("alone"))
    best = levels.select("cell", "bits", "prefix").join(fits, ["bits", "prefix"]).groupBy("cell").agg(F.min(F.struct("bits", "prefix", "alone")).alias("best"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "best.bits", "best.prefix", "best.alone")


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n_bytes, shard_bits, shard_prefix and shard_page.

    Rows with the same (shard_bits, shard_prefix, shard_page) form a shard of at most ``limit`` bytes
    of text. A single text above the limit is a shard of its own. Rows with equal id and text can't be
    told apart by their key: where they exceed the limit together they fill overflow pages 0, 1, ...;
    all other rows have page 0. Null ids and texts count as empty strings. An empty table gives an
    empty result. Input columns named like the four new ones are replaced.
    """
    extra = ("n_bytes", "shard_bits", "shard_prefix", "shard_page")
    docs = docs.drop(*extra)
    measured = docs.withColumns({"_key": shard_key(), "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    keys = cut(measured.groupBy(F.col("_key").alias("key")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("rows")))
    total = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = min(KEY_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + SPARE_BITS)
    left, floor_bits, passes = keys, 0, []
    while True:
        directory = cut(_directory(left, floor_bits, depth, limit))
        open_cells = directory.where("bits is null").select("cell")
        passes.append((depth, directory))
        if depth == KEY_BITS or not open_cells.limit(1).count():
            break
        at = F.shiftright("key", KEY_BITS - depth)
        left = left.join(open_cells, at == F.col("cell"), "left_semi")
        floor_bits, depth = depth + 1, min(KEY_BITS, depth + MORE_BITS)
    # one lookup a row: cells that later passes divide carry these passes' entries, a few hundred at most
    entry = F.struct("bits", "prefix", "alone")
    top, first = passes[0]
    lookup = first.select(F.col("cell").alias("_cell"), F.when(F.col("bits").isNotNull(), entry).alias("_entry0"))
    for k, (depth, directory) in enumerate(passes[1:], 1):
        divided = directory.where("bits is not null").groupBy(F.shiftright("cell", depth - top).alias("_cell")).agg(F.map_from_entries(F.collect_list(F.struct("cell", entry))).alias(f"_entries{k}"))
        lookup = lookup.join(divided, "_cell", "left")
    lookup = cut(lookup)
    lookup = F.broadcast(lookup) if sum(directory.count() for _, directory in passes) <= BROADCAST_ENTRIES else lookup
    cell = lambda depth: F.shiftright("_key", KEY_BITS - depth)
    entries = ["_entry0", *[F.try_element_at(f"_entries{k}", cell(depth)) for k, (depth, _) in enumerate(passes[1:], 1)]]

    def found(rows: DataFrame) -> DataFrame:
        own = rows.join(lookup, cell(top) == F.col("_cell"), "left").withColumn("_entry", F.coalesce(*entries))
        return own.withColumns({"shard_bits": F.coalesce("_entry.bits", F.lit(KEY_BITS)).cast("int"), "shard_prefix": F.coalesce("_entry.prefix", F.col("_key")), "_crowded": F.coalesce("_entry.alone", F.lit(True))})

    single = F.col("_crowded") & (F.col("n_bytes") <= limit)
    columns = [*docs.columns, *extra]
    crowds = keys.where((F.col("n_bytes") > limit) & (F.col("rows") > 1)).select(F.col("key").alias("_key"))
    crowded = crowds.count()
    if not crowded:
        return found(measured).withColumn("shard_page", F.lit(0).cast("long")).select(*columns)
    plain = found(measured).where(~single).withColumn("shard_page", F.lit(0).cast("long"))
    # equal rows: written once with their task, then numbered within it, after the rows of earlier tasks
    equal = measured.join(F.broadcast(crowds) if crowded <= BROADCAST_ENTRIES else crowds, "_key", "left_semi")
    equal = cut(found(equal).where(single).withColumn("_task", F.spark_partition_id()))
    before = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = equal.groupBy("_key", "_task").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    numbered = equal.withColumn("_number", F.row_number().over(Window.partitionBy("_key", "_task").orderBy("doc_id"))).join(tasks, ["_key", "_task"])
    page = F.floor((F.col("_before") + F.col("_number") - 1) / F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    return plain.select(*columns).union(numbered.withColumn("shard_page", page.cast("long")).select(*columns))
