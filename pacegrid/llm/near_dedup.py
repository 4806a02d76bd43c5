"""Near-duplicate groups from SetSketch registers over word shingles.

A text's set holds the hashes of its distinct five-word shingles. Its sketch keeps one register
for each of ``REGISTERS`` hash functions: the exponentially spaced, truncated minimum
``min(LIMIT, max(0, floor(1 - log_b h)))`` with h the least Exp(RATE) value of the set's elements.
Registers of a union are the maxima, and two sets agree in a register with about their Jaccard
similarity, so bands of registers serve as hash keys.

Candidates never become all pairs of a bucket. Texts with equal sets collapse to one node first.
Each node is then held against the centre of its buckets: the node with the most company in all its
buckets, as the original of a group of copies has. Buckets that still hold two components are settled by
an exact join of their sets. With the shingles of each set in one fixed order, the commonest last, two sets
within the threshold share a shingle among their first few; at the first one in common, what either set has
left bounds the intersection, and with it the sizes that still fit. Rows meet by (shingle, band of sizes)
and only across components, so nodes that can't be within the threshold mostly never meet. A pair goes
on if the joint likelihood of its registers does not rule out the threshold, and counts as a link after an
exact comparison of the full sets. A link of similarity 0.8 is in no common bucket with a chance of six in a
hundred thousand, one of 0.85 of three in ten million; the likelihood gives up a link with a chance of one in
ten million (its ratio at SLACK, by the usual chi-square limit).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.common import BYTE_CODE, blocks, cut, distinct_by_row, lower_bytes, mix, prefix_hash, shingles, span_hash, text_buffer, words
from pacegrid.llm.components import components

SHINGLE_WORDS = 5
REGISTERS, BAND = 192, 6
BANDS = REGISTERS // BAND
#: SetSketch parameters: base of the spacing, rate of the exponentials, largest register.
SPACING, RATE, LIMIT = 1.001, 20.0, 65535
#: Pairs whose log-likelihood at the threshold is this far below the best are given up.
SLACK = 14.0
#: Bits of a shingle that name its counter in the table that orders shingles; 2**18 counters are 2 MB at any input.
COUNTER_BITS = 18
#: Step of the size bands, as a logarithm.
SIZE_STEP = math.log(1.05)
PIECE_BYTES = 2 << 20

_seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
_factors, _shifts = _seeds[:REGISTERS] | np.uint64(1), _seeds[REGISTERS:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows and each row's offsets into them."""
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    codes = span_hash(prefix_hash(BYTE_CODE[lower_bytes(data)]), starts, ends)
    hashes, rows, _ = shingles(codes, rows, n, SHINGLE_WORDS)
    hashes, rows = distinct_by_row(hashes, rows)
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def registers(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Registers of each set (uint16, sets x REGISTERS); an empty set's are 0."""
    full = np.flatnonzero(np.diff(cuts))
    out = np.zeros((len(cuts) - 1, REGISTERS), np.uint16)
    if len(full):
        held = np.empty_like(hashes)
        least = np.empty((len(full), REGISTERS))
        for k in range(REGISTERS):
            np.multiply(hashes, _factors[k], out=held)
            np.add(held, _shifts[k], out=held)
            least[:, k] = np.minimum.reduceat(held, cuts[full])
        exponential = -np.log1p(-(least + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
        out[full] = np.clip(np.floor(1 - np.log(exponential) / np.log(SPACING)), 0, LIMIT)
    return out


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the registers of pairs (rows of a and b) of sets with n_a and n_b elements leave a
    similarity of ``least`` or more likely enough: maximum of the joint likelihood of the counts of
    larger, smaller and equal registers over a grid, against its maximum over values >= ``least``."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    share = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = share(u - v * j), share(v - u * j)
        return above * np.log(np.maximum(p, 1e-9)) + below * np.log(np.maximum(q, 1e-9)) + equal * np.log(np.maximum(1 - p - q, 1e-9))

    steps = np.linspace(0, 1, 33)[None, :]
    best = log_likelihood(steps * most).max(1)
    held = log_likelihood(least + steps * np.maximum(most - least, 0)).max(1)
    return (most[:, 0] >= least - 1e-9) & (held >= best - SLACK)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(batch.column("text"))
    for a, b in blocks(offsets, PIECE_BYTES):
        yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _node(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, hashes, cuts in _pieces(batch):
            rows = registers(hashes, cuts)
            sizes = np.diff(cuts)
            nodes = [_node(hashes[x:y]) if y > x else None for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            kept = [batch.column(x)[a:b] for x in ("doc_id", "same", "row")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes.astype(np.int64)), pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], ["doc_id", "same", "row", "n_shingles", "node", "registers"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = batch.column("node").to_pylist()
        for a, b, hashes, cuts in _pieces(batch):
            found = [(asked[a + k], hashes[x:y].tobytes()) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x and _node(hashes[x:y]) == asked[a + k]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], ["node", "elements"])


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy denominator * intersection >= numerator * union."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("registers_a", "registers_b"))
                n_a, n_b = (batch.column(x).to_numpy().astype(float) for x in ("n_a", "n_b"))
                keep = pa.array(plausible(a, b, n_a, n_b, numerator / denominator))
                yield batch.select(["a", "b", "n_a", "n_b"]).filter(keep)

    def equal_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("elements_a").to_pylist(), batch.column("elements_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(denominator * both >= numerator * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda df, value, k: df.select(F.col("node").alias(k), *[F.col(v).alias(f"{v}_{k}" if v != "n_shingles" else f"n_{k}") for v in value])
    known = ["registers", "n_shingles"]
    likely_pairs = pairs.join(side(nodes, known, "a"), "a").join(side(nodes, known, "b"), "b").select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(likely, "a long, b long, n_a long, n_b long")
    full = likely_pairs.join(side(sets, ["elements"], "a"), "a").join(side(sets, ["elements"], "b"), "b")
    return full.select("a", "b", "elements_a", "elements_b").mapInArrow(equal_enough, "a long, b long")


def _merge(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, comp) after more links."""
    if comps is None:
        return components(links)
    links = cut(links)
    if not links.limit(1).count():
        return comps
    top = lambda k: comps.select(F.col("node").alias(k), F.col("comp").alias(f"{k}_comp"))
    between = links.join(top("a"), "a", "left").join(top("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b")
    more = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
    old = comps.join(more, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp"))
    new = more.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("higher").alias("comp"))
    return cut(old.union(new))


def _with_component(rows: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of column ``node``; a node without links is its own."""
    return rows.join(comps.select(F.col("node").alias(node), F.col("comp").alias(f"_{name}")), node, "left").withColumn(name, F.coalesce(f"_{name}", node)).drop(f"_{name}")


def _counter(elements: np.ndarray, bits: int) -> np.ndarray:
    return (elements >> np.uint64(64 - bits)).astype(np.int64)


def _commonness(sets: DataFrame, bits: int) -> np.ndarray:
    """Elements of ``sets`` (elements) by counter: a table of fixed size, summed up in Spark."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            total += np.bincount(_counter(np.frombuffer(b"".join(batch.column("elements").to_pylist()), np.uint64), bits), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["counter", "n"])

    found = sets.select("elements").mapInArrow(tally, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def _first_elements(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(key, node, comp, size, most): the first elements of each of ``sets`` (node, comp, elements), enough for one in
    common with any set within the threshold. most: elements from this one on, itself included."""
    bits = COUNTER_BITS
    shared = sets.sparkSession.sparkContext.broadcast(_commonness(sets, bits))  # 2**COUNTER_BITS numbers at any input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, most = [], []
            for x in batch.column("elements").to_pylist():
                own = np.frombuffer(x, np.uint64)
                n = len(own) + (-numerator * len(own)) // denominator + 1
                keys.append(own[np.lexsort((own, shared.value[_counter(own, bits)]))[:n]].view(np.int64))
                most.append(len(own) - np.arange(n))
            if keys:
                each = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
                size = np.array([len(x) // 8 for x in batch.column("elements").to_pylist()])[each]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[batch.column(c).take(pa.array(each)) for c in ("node", "comp")], pa.array(size), pa.array(np.concatenate(most))], ["key", "node", "comp", "size", "most"])

    return sets.select("node", "comp", "elements").mapInArrow(work, "key long, node long, comp long, size long, most long")


def _exact_pairs(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) of different components of ``sets`` (node, comp, elements), all that are within the threshold among them.

    The smaller set of a pair needs fewer first elements (as no partner of its size or more can do with a
    smaller intersection), and the larger one knows from its ``most`` which sizes can still fit. Cells are
    elements with a band of sizes: the smaller set is in its own size's cell, the larger one in those of all
    sizes that fit. In each cell the commonest component doesn't meet itself.
    """
    both = numerator + denominator
    first = cut(_first_elements(sets, numerator, denominator))
    mixed = first.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    first = cut(first.join(mixed, "key"))
    band = lambda size: F.floor(F.ln(size) / SIZE_STEP).cast("long")
    columns = [F.xxhash64("key", "band").alias("cell"), "node", "comp", "size", "most"]
    smaller = first.where(f"most * {both}L >= 2 * {numerator}L * size").withColumn("band", band(F.col("size"))).select(*columns, F.lit(True).alias("smaller"))
    fitting = first.withColumns({"least": F.expr(f"({numerator}L * size + {denominator - 1}L) div {denominator}L"), "largest": F.expr(f"least(size, most * {both}L div {numerator}L - size)")}).where("largest >= least")
    larger = fitting.withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.col("largest"))))).select(*columns, F.lit(False).alias("smaller"))
    cells = cut(smaller.union(larger))
    counts = cells.groupBy("cell", "comp").agg(F.count("*").alias("n"), F.max("smaller").alias("any_smaller"), F.min("smaller").alias("all_smaller"))
    common = counts.groupBy("cell").agg(F.max(F.struct("n", "comp")).alias("most_common"), F.count("*").alias("comps"), F.max("any_smaller").alias("any_smaller"), F.min("all_smaller").alias("all_smaller"))
    meeting = common.where("comps > 1 and any_smaller and not all_smaller").select("cell", F.col("most_common.comp").alias("common"))
    cells = cut(cells.join(meeting, "cell").withColumn("common", F.col("comp") == F.col("common")))
    a = cells.where("smaller").select("cell", F.col("node").alias("a"), "comp", "size", "most", "common")
    b = cells.where("not smaller").select("cell", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("size").alias("size_b"), F.col("most").alias("most_b"), F.col("common").alias("common_b"))
    near = f"comp <> comp_b and (size < size_b or size = size_b and a < b) and least(most, most_b) * {both}L >= (size + size_b) * {numerator}L"
    met = a.where("not common").join(b, "cell").where(near).select("a", "b").union(a.where("common").join(b.where("not common_b"), "cell").where(near).select("a", "b"))
    return met.distinct()


def _grouped(docs: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (doc_id, text, same) with words: doc_id, same, n_shingles, comp (component), component_id; and the others: doc_id, n_shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "same").withColumn("row", F.xxhash64("doc_id", "text"))
    sketches = cut(docs.mapInArrow(_sketch, "doc_id long, same string, row long, n_shingles long, node long, registers binary"))
    some = sketches.where("n_shingles > 0")
    nodes = cut(some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("registers").alias("registers")))
    keys = [F.xxhash64(F.lit(k), F.substring("registers", 2 * BAND * k + 1, 2 * BAND)) for k in range(BANDS)]
    bands = nodes.select("node", F.col("n_shingles").alias("size"), F.explode(F.array(*keys)).alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = bands.join(buckets, "key")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    members = cut(shared.join(weights, "node"))
    asked = nodes.join(members.select("node"), "node", "left_semi").select("row", F.col("node"))
    sets = cut(docs.select("row", "text").join(asked, "row").dropDuplicates(["row"]).select("node", "text").mapInArrow(_sets, "node long, elements binary"))
    verify = lambda pairs: _links(pairs, nodes, sets, numerator, denominator)
    pivots = members.groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("pivot")).select("key", "pivot.node", F.col("pivot.size").alias("pivot_size"))
    near = f"least(size, pivot_size) * {denominator}L >= greatest(size, pivot_size) * {numerator}L"
    stars = members.select("key", "size", F.col("node").alias("a")).join(pivots, "key").where(f"a <> node and {near}").select("a", F.col("node").alias("b")).distinct()
    comps = _merge(None, verify(stars.select("a", "b")))
    # a bucket is settled only within one component
    known = _with_component(members.select("key", "node"), comps, "node", "comp")
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = cut(sets.join(known.join(mixed, "key", "left_semi").select("node", "comp").distinct(), "node"))
    if rest.limit(1).count():
        comps = _merge(comps, verify(_exact_pairs(rest, numerator, denominator)))
    placed = nodes.select("node", "doc_id").join(comps, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    smallest = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(smallest, "comp").select("node", "comp", "component_id")
    return some.join(named, "node").select("doc_id", "same", "n_shingles", "comp", "component_id"), sketches.where("n_shingles = 0").select("doc_id", "n_shingles")


def near_duplicates(docs: DataFrame, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked if denominator * |A and B| >= numerator * |A or B| for their sets of distinct
    five-word shingles (A-Z lower-cased, words are runs of bytes other than space and 0x09-0x0D; with
    fewer words the whole sequence). component_id is the smallest doc_id that links reach; kept says
    that it is the row's own. A null text, or one without words, has n_shingles 0 and is linked with
    nothing. Repeated rows are linked with each other and share a doc_id, so all of them say kept. A
    null doc_id is reached like any other and never the smallest, unless nothing else is there.
    """
    linked, wordless = _grouped(docs.withColumn("same", F.lit(None).cast("string")), numerator, denominator)
    alone = wordless.withColumn("component_id", F.col("doc_id"))
    return linked.drop("same", "comp").unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """``docs`` (doc_id, text, any others) with one row of each component of near_duplicates().

    The row of the smallest doc_id stays, null ids last; of equal ids that of the smallest MD5 of id and text,
    of rows equal in both any one. Rows without words are linked with nothing: all of them stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("_wordless", text.rlike(r"\A[\x20\x09-\x0D]*\z"))
    worded = docs.where("not _wordless").withColumn("_same", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary")))
    linked, _ = _grouped(worded.select("doc_id", "text", F.col("_same").alias("same")), numerator, denominator)
    first = linked.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "same")).alias("first")).select(F.col("first.same").alias("_same"))
    kept = worded.join(first, "_same", "left_semi").dropDuplicates(["_same"]).drop("_same")
    return kept.unionByName(docs.where("_wordless")).drop("_wordless")
