"""Merkle manifest of a dataset: one tree a language, and one over the languages' subroots.

A leaf's place among its language's is found without a global sort. Its key, the hexadecimal digits of
doc_id and then of the leaf, falls into a histogram by the digits that tell its language's keys apart; buckets
above ``BUCKET_ROWS`` get a histogram by more digits of their own, and sums over the sibling digits in front
give each bucket's first rank. Only within a bucket rows are sorted. Digits of the rank in base 8 are the keys
of a trie whose inner nodes are the tree's: leaves are grouped by the longest prefix that leaves ``STEP`` digits
open, three levels are hashed there at once, and the shorter prefixes that remain are grouped again, up to the
root. Going down the same groups, every leaf gets what stands before and behind it in each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm.common import ascii_lower, cut

#: Nodes that become one, as a power of two, and rank digits that one grouping takes: groups of 512 nodes.
FANOUT_BITS, STEP = 3, 3
#: Rows that a bucket of ranks is planned for, and digits that one histogram takes at most.
BUCKET_ROWS, MOST_DIGITS = 1024, 3
#: Buckets to divide that are broadcast to the rows (about 100 bytes each); more are joined by shuffle.
BROADCAST_ENTRIES = 100_000
_FANOUT, _GROUP = 1 << FANOUT_BITS, 1 << FANOUT_BITS * STEP
_PATH = "array<struct<before:string,after:string>>"


def _said(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its bytes' number and itself."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a leaf of these values, in hexadecimal."""
    return F.sha2(F.concat(*map(_said, values)), 256)


def _joined(nodes: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(nodes, start + 1, count), "")


def _above(nodes: Column) -> Column:
    """The next level: every run of nodes hashed."""
    runs = F.sequence(F.lit(0), (F.size(nodes) - 1).bitwiseAND(-_FANOUT), F.lit(_FANOUT))
    return F.transform(runs, lambda start: F.sha2(_joined(nodes, start, F.lit(_FANOUT)), 256))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, key, copies, any others) with rank: copies of the same tree with smaller keys.

    No two rows may have the same tree and key; keys are texts of hexadecimal digits.
    """
    rows = cut(rows.withColumn("_bucket", F.lit("")))
    sizes = rows.groupBy("tree", "_bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    sizes = cut(sizes.withColumn("start", F.lit(0).cast("long")))
    common = F.expr("coalesce(array_min(filter(sequence(1, length(low)), i -> substring(low, i, 1) <> substring(high, i, 1))), length(low) + 1) - 1")
    digits = F.least(F.lit(MOST_DIGITS), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / BUCKET_ROWS) / 4)))
    starts = None
    while True:
        large = (F.col("n") > BUCKET_ROWS) & (F.col("low") < F.col("high"))
        whole = sizes.where(~large).select("tree", "_bucket", "start")
        starts = whole if starts is None else starts.union(whole)
        divided = sizes.where(large).select(F.col("tree").alias("_tree"), F.col("_bucket").alias("_parent"), "start", (common + digits).cast("int").alias("_depth"))
        many = divided.count()
        if not many:
            break
        divided = F.broadcast(divided) if many <= BROADCAST_ENTRIES else divided
        found = rows.join(divided, (F.col("tree") == F.col("_tree")) & (F.col("_bucket") == F.col("_parent")), "left")
        found = cut(found.withColumn("_bucket", F.when(F.col("_depth").isNotNull(), F.expr("substring(key, 1, _depth)")).otherwise(F.col("_bucket"))).drop("_tree", "_depth"))
        children = found.where("start is not null").groupBy("tree", "_parent", "_bucket").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("key").alias("low"), F.max("key").alias("high"), F.first("start").alias("first"))
        before = Window.partitionBy("tree", "_parent").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = cut(children.withColumn("start", F.col("first") + F.coalesce(F.sum("copies").over(before), F.lit(0))).select("tree", "_bucket", "n", "low", "high", "start"))
        rows = found.drop("_parent", "start")
    before = Window.partitionBy("tree", "_bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["tree", "_bucket"])
    return placed.withColumn("rank", F.col("start") + F.coalesce(F.sum("copies").over(before), F.lit(0))).drop("_bucket", "start")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Groups of the trees over ``nodes`` (tree, rank, copies, digest, own), a table for each ``STEP`` levels, from the leaves up.

    A group has tree, levels (of its tree), part (its rank prefix), own (of its nodes), level0 .. level2
    (digests of its nodes, then of the runs above) and top, the digest of the group itself.
    """
    sizes = nodes.groupBy("tree").agg(F.sum("copies").alias("n"))
    levels = sum(((F.col("n") > _FANOUT**k).cast("int") for k in range(1, 63 // FANOUT_BITS)), (F.col("n") > 1).cast("int"))
    sizes = cut(sizes.select("tree", levels.alias("levels")))
    most = sizes.agg(F.max("levels")).first()[0] or 0
    nodes, steps = nodes.join(sizes, "tree"), []
    while True:
        bits, base = FANOUT_BITS * STEP, STEP * len(steps)
        # a row of many copies stands in every group that it reaches into, with its copies there
        parts = F.sequence(F.shiftright("rank", bits), F.shiftright(F.col("rank") + F.col("copies") - 1, bits))
        reach = nodes.withColumn("part", F.explode(parts)).withColumns({"_from": F.greatest("rank", F.shiftleft("part", bits)), "_to": F.least(F.col("rank") + F.col("copies"), F.shiftleft(F.col("part") + 1, bits))})
        entry = F.struct("_from", (F.col("_to") - F.col("_from")).cast("int").alias("count"), "digest", "own")
        groups = reach.groupBy("tree", "levels", "part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        each = lambda field: F.flatten(F.transform("entries", lambda e: F.array_repeat(e[field], e["count"])))
        groups = groups.select("tree", "levels", "part", each("own").alias("own"), each("digest").alias("level0"))
        for k in range(STEP):
            groups = groups.withColumn(f"level{k + 1}", F.when(F.col("levels") > base + k, _above(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
        groups = cut(groups.withColumn("top", F.col(f"level{STEP}")[0]).drop(f"level{STEP}"))
        steps.append(groups)
        if base + STEP >= most:
            return steps
        nodes = groups.select("tree", "levels", F.col("part").alias("rank"), F.lit(1).alias("copies"), F.col("top").alias("digest"), F.lit(None).cast("void").alias("own"))


def descend(steps: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, own, digest, path, others of tops) of all leaves of climb()'s ``steps``, one row a copy.

    ``tops`` (tree, path, any others) has the path above each tree's top. A path holds, level by level
    from the leaf up, the digests before and behind its node in the run, each joined.
    """
    others = [c for c in tops.columns if c not in ("tree", "path")]
    above = tops.withColumn("part", F.lit(0).cast("long"))
    for k in range(len(steps) - 1, -1, -1):
        groups = steps[k].join(above, ["tree", "part"])

        def local(at: Column, base: int = STEP * k) -> Column:
            found = []
            for i in range(STEP):
                nodes, place = F.col(f"level{i}"), F.shiftright(at, FANOUT_BITS * i)
                start = place.bitwiseAND(-_FANOUT)
                run = F.struct(_joined(nodes, start, place - start).alias("before"), _joined(nodes, place + 1, start + (_FANOUT - 1) - place).alias("after"))
                found.append(F.when(F.col("levels") > base + i, run))
            return F.filter(F.array(*found), lambda x: x.isNotNull())

        every = F.transform(F.sequence(F.lit(0), F.size("level0") - 1), lambda at: F.struct(at.alias("at"), F.get("own", at).alias("own"), F.get("level0", at).alias("digest"), F.concat(local(at), F.col("path")).alias("path")))
        above = groups.select("tree", F.col("part").alias("_part"), *others, F.inline(every))
        above = above.withColumn("part", F.shiftleft("_part", FANOUT_BITS * STEP) + F.col("at")).drop("_part", "at")
        if k:
            above = above.drop("own", "digest")
    return above.drop("part")


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A language's leaves ascend by doc_id, null first; equal ids by their leaves, and rows equal in all five
    columns stand next to each other and get one output row each. Null is a language of its own, the first. Rows
    whose id's crc32 is a multiple of 3 are verified with A-Z of the text in lower case: they fail unless
    that changes nothing. A null id has no crc32 and isn't tampered with, nor is a null text. Empty and very
    long texts are values like others. Other columns are ignored. An empty table gives an empty result.
    """
    five = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(*five[:-1], ascii_lower(F.col("text"))))
    tree = F.coalesce(F.concat(F.lit("1"), F.hex(F.col("lang").cast("string"))), F.lit("0"))
    leaves = docs.select(*five).select("doc_id", tree.alias("tree"), leaf(*five).alias("digest"), tampered.alias("changed"))
    leaves = leaves.groupBy("tree", "doc_id", "digest", "changed").agg(F.count("*").alias("copies"))
    # ids in the order of longs: with the sign bit turned round, hexadecimal digits sort like the numbers
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0" * 17)), F.col("digest"))
    rows = leaves.select("tree", key.alias("key"), "copies", "digest", F.struct("doc_id", "changed").alias("own"))
    steps = climb(ranked(rows))
    subroots = steps[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.lit(1).cast("long").alias("copies"), F.col("top").alias("digest"), F.col("tree").alias("own"))
    above = climb(ranked(subroots))
    root = above[-1].select("tree", F.array().cast(_PATH).alias("path"), F.col("top").alias("root"))
    tops = cut(descend(above, root).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path", "root"))
    found = descend(steps, tops)
    folded = F.aggregate("path", F.coalesce("own.changed", "digest"), lambda at, run: F.sha2(F.concat(run["before"], at, run["after"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda run: F.concat(run["before"], run["after"])), ""), 256)
    found = found.select("own.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
