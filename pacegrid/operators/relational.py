"""Ordered dedupe, priority merges, carry-forward, funnels and reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.operators.lineage import written

#: Rounds of a large dedupe that may settle little, and undecided rows that one task may walk at a time.
PARALLEL_ROUNDS, GROUP_ROWS = 3, 1_000_000
#: A round that settles less than this part of the undecided rows settled little.
LITTLE = 1 / 16


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int = 1) -> DataFrame:
    """The first ``limit`` rows of each key in the given order. Null is a key of its own."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= limit).drop("_place")


def first_strategy(found: DataFrame, page: str, rank: str) -> DataFrame:
    """Rows of the best-ranked strategy that found anything on a page."""
    best = found.groupBy(F.col(page).alias("_page")).agg(F.min(rank).alias("_best"))
    return found.join(best, F.col(page).eqNullSafe(F.col("_page")) & (F.col(rank) == F.col("_best"))).drop("_page", "_best")


def carry_forward(previous: DataFrame, fresh: DataFrame, refreshed: list[str], source: str = "source") -> DataFrame:
    """Fresh rows, and the previous rows of sources that were not refreshed (``carried``); a null source is carried."""
    kept = previous.where(~F.coalesce(F.col(source).isin(*refreshed), F.lit(False)))
    return kept.withColumn("carried", F.lit(True)).unionByName(fresh.withColumn("carried", F.lit(False)))


def prefer_details(listings: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """One row of each key: the detail's where there is one, else the listing's, whole. Both sides have
    the same columns and one row a key at most; ``from_detail`` says which it was."""
    rest = [c for c in listings.columns if c != key]
    left = listings.select(key, F.struct(*rest).alias("_listing"))
    right = details.select(key, F.struct(*rest).alias("_detail"))
    merged = left.join(right, key, "full").withColumn("_row", F.coalesce("_detail", "_listing"))
    return merged.select(key, "_row.*", F.col("_detail").isNotNull().alias("from_detail"))


def ordered_upsert(listings: DataFrame, details: DataFrame, key: str, place: str) -> DataFrame:
    """One row of each key, as if the rows came one by one, all listings before all details: the key keeps the
    place where it first came, the first listing stands until a detail comes, and the last detail stays. ``position``
    (side, place) sorts like that; ``from_detail`` says whose row it is. Both sides have the same columns, and ``place`` is
    unique on each side. Rows are combined by key before the shuffle; a null key is a key of its own."""
    rest = [c for c in listings.columns if c != key]
    sides = [df.select(key, F.lit(side).alias("_side"), F.struct(*rest).alias("_row")) for side, df in enumerate((listings, details))]
    at = F.struct("_side", F.col(f"_row.{place}").alias("place"))
    listed, told = F.when(F.col("_side") == 0, at), F.when(F.col("_side") == 1, at)
    merged = sides[0].union(sides[1]).groupBy(key).agg(F.min(at).alias("_at"), F.min_by("_row", listed).alias("_listing"), F.max_by("_row", told).alias("_detail"))
    chosen = merged.withColumn("_row", F.coalesce("_detail", "_listing"))
    return chosen.select(key, "_row.*", F.struct(F.col("_at._side").alias("side"), F.col("_at.place").alias("place")).alias("position"), F.col("_detail").isNotNull().alias("from_detail"))


def lookup_with_fallback(df: DataFrame, keys: list[str], known: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with ``value`` of the first of ``keys`` that ``known`` (key, value) has a non-null value for."""
    found = []
    for k, name in enumerate(keys):
        side = known.select(F.col(key).alias(f"_key{k}"), F.col(value).alias(f"_value{k}"))
        df = df.join(side, F.col(name) == F.col(f"_key{k}"), "left").drop(f"_key{k}")
        found.append(f"_value{k}")
    return df.withColumn(value, F.coalesce(*found)).drop(*found)


def finished_before(start: Column, end: Column, day: str) -> Column:
    """Whether the last known day, as text, lies before ``day``; undated rows are not finished."""
    last = F.coalesce(F.nullif(F.substring(end, 1, 10), F.lit("")), F.nullif(F.substring(start, 1, 10), F.lit("")))
    return F.coalesce(last < day, F.lit(False))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """One row: ``seen``, for each step the rows that it, as the first, rejects, and ``kept``; one pass."""
    rejected = [F.coalesce(test, F.lit(False)) for _, test in steps]
    counts, open_so_far = [F.count("*").alias("seen")], F.lit(True)
    for (name, _), test in zip(steps, rejected, strict=True):
        counts.append(F.count_if(open_so_far & test).alias(name))
        open_so_far = open_so_far & ~test
    return df.agg(*counts, F.count_if(open_so_far).alias("kept"))


def survivors(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows that no step of a funnel rejects."""
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(test, F.lit(False)) for _, test in steps]))


def site_status(sites: DataFrame, events: DataFrame) -> DataFrame:
    """``sites`` (source, enabled, requires_js, http_status, error) with n and status: skipped, blocked,
    error, empty or ok."""
    counts = events.groupBy("source").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    status = F.when(~F.col("enabled"), "skipped").when(F.col("requires_js") & (n == 0), "blocked").when(F.col("error").isNotNull(), "error").when(n == 0, "empty").otherwise("ok")
    return sites.join(counts, "source", "left").select("source", n.alias("n"), status.alias("status"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its global place, from 0, in the given order, which must be total to be reproducible.

    Rows are range-partitioned and numbered within each part; only the counts of the parts are added up in one
    place, so no task sees all rows.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_part", "_start", "_own")


def conflict_groups(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of ``edges`` (a, b): comp is the smallest node that edges reach. Labels spread to
    neighbours and then jump to their labels' labels, so rounds grow with the logarithm of a chain's length."""
    both = written(edges.union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        # hook: the least label around a component's nodes goes to its root, then every root's label is followed
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        seen = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("near"))
        roots = seen.groupBy("comp").agg(F.min("near").alias("top")).select(F.col("comp").alias("node"), "top")
        hooked = written(seen.join(roots, "node", "left").select("node", "comp", F.least("near", F.coalesce("top", "near")).alias("lower")))
        above = hooked.select(F.col("node").alias("lower"), F.col("lower").alias("top"))
        moved = written(hooked.join(above, "lower").select("node", F.col("top").alias("comp"), (F.col("top") < F.col("comp")).alias("moved")))
        labels = moved.select("node", "comp")
        if not moved.where("moved").limit(1).count():
            return labels


def _greedy_round(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (_seq, _id, _key): those that come first for both keys, and what neither is nor conflicts with these."""
    by_id = undecided.groupBy("_id").agg(F.min("_seq").alias("_seq")).select("_seq")
    by_key = undecided.where("_key is not null").groupBy("_key").agg(F.min("_seq").alias("_seq")).select("_seq")
    free = undecided.where("_key is null").select("_seq")
    chosen = written(undecided.join(by_id, "_seq", "left_semi").join(by_key.union(free), "_seq", "left_semi").select("_seq", "_id", "_key"))
    return chosen, written(_without(undecided, chosen))


def _without(undecided: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``undecided`` whose id and key no row of ``chosen`` has."""
    left = undecided.join(chosen.select("_id"), "_id", "left_anti").join(chosen.where("_key is not null").select("_key"), "_key", "left_anti")
    return left.select("_seq", "_id", "_key")


def _walk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept rows of (_seq, _id, _key), which come in order."""
    ids, keys = set(), set()
    for batch in batches:
        kept = []
        for at, (row_id, key) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_id", "_key")], strict=True)):
            if row_id not in ids and (key is None or key not in keys):
                ids.add(row_id)
                keys.add(key)
                kept.append(at)
        yield batch.take(pa.array(kept, pa.int64()))


def _walked(rows: DataFrame) -> DataFrame:
    """Kept rows of ``rows``, walked in order by one task."""
    return rows.select("_seq", "_id", "_key").repartition(1).sortWithinPartitions("_seq").mapInArrow(_walk_rows, "_seq long, _id string, _key string")


def _first_rows(undecided: DataFrame, left: int) -> tuple[DataFrame, DataFrame]:
    """Of the ``left`` rows of ``undecided``: those kept of about the first GROUP_ROWS, walked by one task, and what comes after these and
    conflicts with none of the kept. Nothing before the first rows is open, so wherever they end, what is kept of them stays."""
    part = GROUP_ROWS / left
    last = undecided.approxQuantile("_seq", [part], part / 4)[0]
    chosen = written(_walked(undecided.where(F.col("_seq") <= last)))
    return chosen, written(_without(undecided.where(F.col("_seq") > last), chosen))


def _walk_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _walk_rows() for conflict groups one after another, ids and keys being numbers within their group: one bit each."""
    group, ids, keys = None, bytearray(), bytearray()
    for batch in batches:
        kept = []
        for comp, seq, i, k, n_ids, n_keys in zip(*[batch.column(c).to_pylist() for c in ("comp", "_seq", "_id_no", "_key_no", "_ids", "_keys")], strict=True):
            if comp != group:
                group, ids, keys = comp, bytearray(n_ids // 8 + 1), bytearray(n_keys // 8 + 1)
            if ids[i >> 3] >> (i & 7) & 1 or (k is not None and keys[k >> 3] >> (k & 7) & 1):
                continue
            ids[i >> 3] |= 1 << (i & 7)
            if k is not None:
                keys[k >> 3] |= 1 << (k & 7)
            kept.append(seq)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], ["_seq"])


def _walk_groups(undecided: DataFrame) -> DataFrame:
    """Kept rows of ``undecided``, each conflict group walked by one task. The rows stream past in Spark's own order, which spills,
    and the state is two bits a row at most, so a group of a billion rows takes 250 MB. The walk is sequential by nature; the
    number of jobs grows with the logarithm of the longest chain only, for conflict_groups()."""
    first = lambda c: undecided.where(f"{c} is not null").groupBy(c).agg(F.min("_seq").alias("b"))
    edges = [undecided.join(first(c), c).select(F.col("_seq").alias("a"), "b") for c in ("_id", "_key")]
    groups = conflict_groups(edges[0].union(edges[1]))
    rows = written(undecided.join(groups.withColumnRenamed("node", "_seq"), "_seq", "left").withColumn("comp", F.coalesce("comp", "_seq")))
    for name in ("_id", "_key"):
        values = numbered(rows.where(f"{name} is not null").select("comp", name).distinct(), [F.col("comp"), F.col(name)], "_no")
        spans = values.groupBy("comp").agg(F.min("_no").alias("_from"), F.count("*").alias(f"{name}s"))
        rows = rows.join(values, ["comp", name], "left").join(spans, "comp", "left").withColumn(f"{name}_no", F.col("_no") - F.col("_from")).drop("_no", "_from", name)
        rows = rows.fillna(0, [f"{name}s"])
    return rows.repartition("comp").sortWithinPartitions("comp", "_seq").mapInArrow(_walk_numbers, "_seq long")


def dual_key_dedupe(df: DataFrame, row_id: str, key: str, seq: str) -> DataFrame:
    """Rows of an ordered greedy dedupe over two keys: a row is dropped if its id or its key already
    stands on a kept row; dropped rows count for nothing. A null or empty key never conflicts; a null id is an id of its own.

    ``seq`` is unique and gives the order. Of rows with the same id and key only the first can stay, the others count no further.
    While over GROUP_ROWS rows are undecided, rounds keep those that come first for both of their keys, then walk the first
    GROUP_ROWS rows that are left, and drop what conflicts with the kept ones; that gives the same rows as the row-by-row
    walk. Rounds go on until PARALLEL_ROUNDS of them settled less than LITTLE, so their rows add up to twenty times the input at most.
    What is left then is walked by one task if it has at most GROUP_ROWS rows, else by conflict groups, see
    _walk_groups(). Per-key minima are combined before shuffles.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col(row_id).cast("string")), F.lit(""))
    pairs = df.groupBy(own.alias("_id"), F.nullif(F.col(key).cast("string"), F.lit("")).alias("_key")).agg(F.min(F.col(seq).cast("long")).alias("_seq"))
    undecided, kept, slow = written(pairs.select("_seq", "_id", "_key")), [], 0
    left = undecided.count()
    while left > GROUP_ROWS and slow < PARALLEL_ROUNDS:
        before = left
        for step in (_greedy_round, lambda rows: _first_rows(rows, left)):
            if left > GROUP_ROWS:
                chosen, undecided = step(undecided)
                kept.append(chosen.select("_seq"))
                left = undecided.count()
        slow += before - left < LITTLE * before
    if left > GROUP_ROWS:
        kept.append(_walk_groups(undecided))
    elif left or not kept:
        kept.append(_walked(undecided).select("_seq"))
    return df.join(written(reduce(DataFrame.union, kept)).select(F.col("_seq").alias(seq)), seq, "left_semi")


def facets(df: DataFrame, column: str, missing: str) -> DataFrame:
    """Counts by value, most frequent first, then by value; null and empty count as ``missing``."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing)).alias(column)
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
