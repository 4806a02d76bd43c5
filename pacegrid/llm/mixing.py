"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in a fixed random order, form blocks. With share a of W slots, block i (from 1) of
a source is released at slot floor((i - 1) W / a) and due by slot ceil(i W / a). Earliest deadline first
over unit blocks meets all these deadlines, so after any number of slots every source has had
within one block of its target. The pattern repeats after W slots: it is worked out once for the
weights (a setting, not data) and joined to the numbered blocks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 60
#: Slots of a pattern at most; weights are given as integers with a sum of up to this.
MOST_SLOTS = 10_000
#: Rows that one window task is planned for.
RUN_ROWS = 20_000


def pattern(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, step, slot) for one round of sum(weights) slots: slot of each source's step-th block."""
    total = sum(weights.values())
    if not 0 < total <= MOST_SLOTS or min(weights.values()) < 1:
        raise ValueError(f"weights must be positive integers with a sum of up to {MOST_SLOTS}")
    window = lambda s, i: (i * total // weights[s], -(-(i + 1) * total // weights[s]))
    waiting = sorted((window(s, 0)[0], window(s, 0)[1], s, 0) for s in weights)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, deadline, source, step = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, source, step))
        _, source, step = heapq.heappop(ready)
        out.append((source, step, slot))
        if step + 1 < weights[source]:
            release, deadline = window(source, step + 1)
            heapq.heappush(waiting, (release, deadline, source, step + 1))
    return out


def order_key(docs: DataFrame) -> Column:
    """KEY_BITS bits that order the rows of a source and deal them to runs: of the id, or of the text where there is no id."""
    said = [F.col(c).cast("string") for c in ("doc_id", "text") if c in docs.columns]
    return F.conv(F.substring(F.md5(F.coalesce(*said, F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: dict[str, int], block_rows: int = 1) -> DataFrame:
    """``docs`` (doc_id, source, any others) with mix_block, mix_slot, mix_place and in_mix.

    All rows stay. Ordered by (mix_slot, mix_place), every prefix of whole blocks up to the first slot
    that its source can't fill follows the weights within a block (in_mix); later slots hold what the
    longer sources still have. Rows whose source is null or without a weight come after all others:
    mix_slot null. Within a source rows stand in the order of an MD5 of their ids (without one, of their texts, if there are any), then the ids, then a hash of
    all plain columns; rows equal in all of these are alike. A weighted source without rows leaves in_mix false throughout. Input
    columns named like the four new ones are replaced. An empty table gives an empty result.
    """
    spark, extra = docs.sparkSession, ("mix_block", "mix_slot", "mix_place", "in_mix")
    docs = docs.drop(*extra)
    total, columns = sum(weights.values()), docs.columns
    turns = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(i).cast("long").alias("_step"), F.lit(t).cast("long").alias("_turn")) for s, i, t in pattern(weights)])
    turns = spark.range(1).select(F.inline(turns))
    shares = F.create_map(*[F.lit(x) for s, a in weights.items() for x in (s, a)])

    def slot(df: DataFrame, block: str) -> DataFrame:
        """With mix_slot, for the block-th block of ``source``; the pattern has at most MOST_SLOTS rows."""
        share = shares[F.col("source")]
        return df.withColumn("_step", F.col(block) % share).join(F.broadcast(turns), ["source", "_step"], "left").withColumn("mix_slot", F.floor(F.col(block) / share) * total + F.col("_turn")).drop("_step", "_turn")

    key = order_key(docs)
    bits = max(0, (docs.count() // RUN_ROWS).bit_length())
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    keyed = docs.withColumns({"_key": key, "_tie": F.xxhash64(*plain), "_run": F.shiftright(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")})
    sizes = keyed.groupBy("source", "_run").count()
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).select(F.col("source").alias("_source"), F.col("_run").alias("_start"), "_before")
    order = Window.partitionBy("source", "_run").orderBy("_key", "doc_id", "_tie")
    numbered = keyed.withColumn("_number", F.row_number().over(order)).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_run") == F.col("_start")))
    rank = F.col("_before") + F.col("_number") - 1
    blocked = numbered.withColumns({"mix_block": F.floor(rank / block_rows), "mix_place": (rank % block_rows).cast("long")})
    have = F.broadcast(turns.select("source").distinct()).join(sizes.groupBy("source").agg(F.sum("count").alias("n")), "source", "left")
    first_gap = slot(have.withColumn("_full", F.floor(F.coalesce("n", F.lit(0)) / block_rows)), "_full").agg(F.min("mix_slot")).first()[0]
    out = slot(blocked, "mix_block").withColumn("in_mix", F.coalesce(F.col("mix_slot") < first_gap, F.lit(False)))
    return out.select(*columns, *extra)
