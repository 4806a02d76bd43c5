"""Language-model scores from a log-frequency Bloom filter of word pairs.

Words are counted exactly (count and number of different followers). Counts of pairs are quantised to
levels that grow by half, and a pair of level q goes into the filter q times, as (pair, 1) to (pair, q); its count
comes back by probing (pair, 1), (pair, 2), ... until a probe fails. A probability is Witten and Bell's mix of
the pair's share of its first word with the share of the second word alone, which is weighted by the first word's
number of followers. All five bits of a probe stand in one 64-bit word of the filter.

The filter is made of segments by pair hash, each as large as its own pairs need, and there are as many as the
training text asks for. While the words have up to four fifths of ``BROADCAST_BYTES`` they are sent to all workers, with as many
segments as the rest has room for; each further group of segments is one more pass over the texts, in which the pairs of
these segments are scored. Nothing of a text is shuffled. Where there are more words, or the segments ask for over
``MOST_PASSES`` passes, the distinct pairs of each document go to the segments and words by shuffle, those in very many
documents to a bounded broadcast, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pacegrid.llm.common import BYTE_CODE, blocks, cut, discard, lower_bytes, mix, prefix_hash, release, span_hash, text_buffer, words

#: Bits of the filter for each insertion: with five bits a probe and 64-bit words, about one absent pair in a hundred passes.
BITS, PROBE_BITS = 12, 5
#: Bytes of training text that a segment is planned for, bytes of text that are split into words at once, and rows that are worked on at once.
SEGMENT_BYTES, PIECE_BYTES, PIECE_ROWS = 1 << 20, 1 << 20, 250
#: Words and a group of segments of up to so many bytes together are broadcast, as each worker process holds them; more words, or a filter that asks for more passes, are joined by shuffle.
BROADCAST_BYTES, MOST_PASSES = 640 << 20, 16
#: Bytes of a word with its count and number of followers in a broadcast; the few of over a byte each have more.
WORD_BYTES = 10
#: They pass through the driver in parts of about so many bytes.
PART_BYTES = 16 << 20
#: A key in one of so many rows or more is hot: there are at most so many of them, and they are broadcast.
HOT_SHARE = 1 << 15
#: What stands for the start of a text and for its end.
BEGIN, END = np.uint64(0x51ED270B0E2F5A77), np.uint64(0x2545F4914F6CDD1D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _levels() -> tuple[np.ndarray, np.ndarray]:
    """Least count of each level, and the count that stands for it, the geometric mean of its range; level 0 is absent."""
    least = [1]
    while least[-1] < 1 << 61:
        least.append(max(least[-1] + 1, least[-1] * 3 // 2))
    means = [0.0, *(float(a * (b - 1)) ** 0.5 for a, b in zip(least, least[1:], strict=False))]
    return np.array(least[:-1]), np.array(means)


LEAST, MEANS = _levels()


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all tokens of a buffer's texts: the words with A-Z lower-cased, then one end a text."""
    found, rows = [], []
    for a, b in blocks(offsets, PIECE_BYTES):
        own = lower_bytes(data[offsets[a] : offsets[b]])
        starts, ends, row = words(own, offsets[a : b + 1] - offsets[a])
        found.append(span_hash(prefix_hash(BYTE_CODE[own]), starts, ends))
        rows.append(row + a)
    n = len(offsets) - 1
    found, rows = np.concatenate([*found, np.full(n, END)]), np.concatenate([*rows, np.arange(n)])
    order = np.argsort(rows, kind="stable")  # ends stand last
    return found[order], rows[order]


def cut_by_small_batches(df: DataFrame) -> DataFrame:
    """cut(), with Arrow batches of so few rows meanwhile that a batch of texts takes little memory next to the model."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(4 * PIECE_ROWS))
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def pieces(batch: pa.RecordBatch, size: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of ``batch`` (text, any others), with their texts' tokens and the tokens' rows, so few that memory is bounded by the longest text."""
    for low in range(0, batch.num_rows, size * PIECE_ROWS):
        some = batch.slice(low, size * PIECE_ROWS)
        data, offsets = text_buffer(some.column("text"))
        for a, b in blocks(offsets, size * PIECE_BYTES):
            yield some.slice(a, b - a), *token_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def pairs_of(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the pairs that end in each token."""
    firsts = np.empty_like(tokens)
    firsts[1:], firsts[:1] = tokens[:-1], BEGIN
    firsts[1:][rows[1:] != rows[:-1]] = BEGIN
    return firsts, mix(firsts * _STEP + tokens)


def tag_of(pairs: np.ndarray) -> np.ndarray:
    """What tells pairs of one first word apart in a segment: 32 bits."""
    return pairs & np.uint64(0xFFFFFFFF)


def segment_of(pairs: np.ndarray, segments: int) -> np.ndarray:
    return ((pairs >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def _place(firsts: np.ndarray, tags: np.ndarray, level: np.ndarray | int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and bits in it for probes, in segments that begin at ``starts`` with ``sizes`` words."""
    code = mix(firsts ^ mix(tags + np.asarray(level, np.uint64) * _STEP))
    mask = np.zeros(len(code), np.uint64)
    for k in range(PROBE_BITS):
        mask |= np.uint64(1) << ((code >> np.uint64(6 * k)) & np.uint64(63))
    return (starts + (((code >> np.uint64(32)) * sizes) >> np.uint64(32))).astype(np.int64), mask


def segment_filter(firsts: np.ndarray, tags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of one segment's distinct pairs."""
    levels = np.searchsorted(LEAST, counts, side="right")
    which = np.repeat(np.arange(len(levels)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    out = np.zeros(max(1, -(-len(which) * BITS // 64)), np.uint64)
    none = np.zeros(len(which), np.uint64)
    at, mask = _place(firsts[which], tags[which], level, none, none + np.uint64(len(out)))
    np.bitwise_or.at(out, at, mask)
    return out


def probe(bits: np.ndarray, firsts: np.ndarray, tags: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Level of each pair: probes go on as long as they pass."""
    out, open_, level = np.zeros(len(firsts), np.int64), np.arange(len(firsts)), 1
    while len(open_) and level <= len(LEAST):
        at, mask = _place(firsts[open_], tags[open_], level, starts[open_], sizes[open_])
        open_ = open_[(bits[at] & mask) == mask]
        out[open_] = level
        level += 1
    return out


#: A pair of a segment with its count in a piece, or a part of it, as a byte keeps the shuffle small; a piece's pairs of one segment go to it together.
_COUNTED = np.dtype([("first", "<u8"), ("tag", "<u4"), ("n", "u1")])


class Model:
    """Tables of a fitted model: ``segments`` (segment, bits) and ``words`` (word, count, followers), and the totals."""

    def __init__(self, segments: DataFrame, words_: DataFrame, n_segments: int) -> None:
        self.segments, self.words, self.n_segments = segments, words_, n_segments
        begin = int(BEGIN.view(np.int64))
        # each token is the first word of one pair, but for the ends; each text has one end
        said = words_.select(F.when(F.col("word") == begin, int(END.view(np.int64))).otherwise(F.col("word")).alias("word"), "count")
        totals = said.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
        self.tokens, self.kinds = totals["tokens"], totals["kinds"]
        self.filter_bytes = segments.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
        self.word_bytes = WORD_BYTES * words_.count()

    def passes(self, most: int) -> int:
        """Passes over the texts that broadcasts of up to ``most`` bytes ask for; none if the words have over four fifths of that."""
        return max(1, -(-self.filter_bytes // max(most - self.word_bytes, 1))) if 5 * self.word_bytes <= 4 * most else 0


def fit(docs: DataFrame) -> Model:
    """The model of all texts of ``docs`` (text); null texts are empty ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(text.alias("text"))
    n_segments = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SEGMENT_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, rows in pieces(batch, 4):  # more rows, fewer repeats to shuffle
                firsts, pairs = pairs_of(hashes, rows)
                order = np.argsort(pairs)
                pairs = pairs[order]
                new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                n = np.diff(np.append(new, len(pairs)))
                if len(pairs) and n.max() > 255:  # several entries, each begun 255 occurrences after the one before
                    times = -(-n // 255)
                    new = np.repeat(new - 255 * (np.cumsum(times) - times), times) + 255 * np.arange(times.sum())
                    n = np.diff(np.append(new, len(pairs)))
                found = np.empty(len(new), _COUNTED)
                found["n"], found["first"], found["tag"] = n, firsts[order[new]], tag_of(pairs[new])
                segment = segment_of(pairs[new], n_segments).astype(np.int32)
                heads = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
                edges = np.append(heads, len(found)) * _COUNTED.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([pa.array(segment[heads]), packed], ["segment", "pairs"])

    def build(parts: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(x.as_buffer() for x in parts.column("pairs")), _COUNTED)
        firsts, tags, n = found["first"].copy(), found["tag"].astype(np.uint64), found["n"].astype(np.int64)
        order = np.lexsort((tags, firsts))
        firsts, tags, n = firsts[order], tags[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (firsts[1:] != firsts[:-1]) | (tags[1:] != tags[:-1])]))
        firsts, tags, n = firsts[new], tags[new], np.add.reduceat(n, new)
        heads = np.flatnonzero(np.concatenate([[True], firsts[1:] != firsts[:-1]]))
        empty = lambda column, kind: pa.concat_arrays([pa.nulls(1, kind), column])  # noqa: E731  the first row holds the filter
        bits = pa.array([segment_filter(firsts, tags, n).tobytes(), *[None] * len(heads)], pa.binary())
        segment = pa.array(np.full(1 + len(heads), parts.column("segment")[0].as_py(), np.int32))
        columns = [segment, bits, *(empty(pa.array(x), pa.int64()) for x in (firsts[heads].view(np.int64), np.add.reduceat(n, heads), np.diff(np.append(heads, len(firsts)))))]
        return pa.Table.from_arrays(columns, ["segment", "bits", "word", "count", "followers"])

    pairs = docs.mapInArrow(count, "segment int, pairs binary")
    built = cut_by_small_batches(pairs.groupBy("segment").applyInArrow(build, "segment int, bits binary, word long, count long, followers long"))
    release(docs.sparkSession)  # the pairs' shuffle, the largest of all
    words_ = cut(built.where("word is not null").groupBy("word").agg(F.sum("count").alias("count"), F.sum("followers").alias("followers")))
    # by ranges, so that a group of segments is read without the others
    filters = cut(built.where("bits is not null").select("segment", "bits").repartitionByRange("segment").sortWithinPartitions("segment"))
    discard(built)
    release(docs.sparkSession)
    return Model(filters, words_, n_segments)


def _broadcast_words(model: Model, context: SparkContext) -> list[Broadcast]:
    """Parts of the words by their hashes: sorted hashes, counts and numbers of followers of those where a byte holds these, then of the rest."""
    n_parts, out = -(-model.word_bytes // PART_BYTES) or 1, []
    for k in range(n_parts):
        table = model.words.where(F.shiftright(F.shiftrightunsigned("word", 32) * n_parts, 32) == k).toArrow()
        order = np.argsort(table.column("word").to_numpy().view(np.uint64))
        word, *facts = (table.column(name).to_numpy()[order] for name in ("word", "count", "followers"))
        rare = np.maximum(*facts) < 256
        out.append(context.broadcast([(word[some].view(np.uint64), *(x[some].astype(kind) for x in facts)) for some, kind in ((rare, np.uint8), (~rare, np.int64))]))
        del table, order, word, facts, rare
    return out


def _broadcast_filters(model: Model, context: SparkContext, bounds: list[int]) -> list[Broadcast]:
    """Segments between each two of ``bounds``: their bits, and the words of the filter that each has."""
    out = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        table = model.segments.where(F.col("segment").between(low, high - 1)).orderBy("segment").toArrow()
        bits = table.column("bits").combine_chunks()
        sizes = np.zeros(high - low, np.uint64)
        sizes[table.column("segment").to_numpy() - low] = np.diff(np.frombuffer(bits.buffers()[1], np.int32)[: len(bits) + 1]) // 8
        out.append(context.broadcast((np.frombuffer(bits.buffers()[2], np.uint64), sizes)))
        del table, bits
    return out


def _pass(docs: DataFrame, model: Model, vocabularies: list[Broadcast], filters: list[Broadcast], bounds: list[int], whole: bool, others: list[str]) -> DataFrame:
    """Scores of the tokens whose pairs lie in the segments within ``bounds``, a sum a text; all other sums are nought but in the ``whole`` pass.
    The columns ``others`` are handed on."""
    n_segments, n_parts, tokens_, kinds = model.n_segments, len(vocabularies), model.tokens, model.kinds

    def looked_up(hashes: np.ndarray) -> np.ndarray:
        """Counts and numbers of followers of sorted hashes."""
        out = np.zeros((2, len(hashes)))
        part = ((hashes >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(n_parts + 1))
        for both, a, b in zip((x.value for x in vocabularies), edges, edges[1:], strict=False):
            for vocabulary, *facts in both:
                at = np.searchsorted(vocabulary, hashes[a:b])
                found = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes[a:b]) if len(vocabulary) else np.zeros(0, int)
                for own, fact in zip(out, facts, strict=True):
                    own[a + found] = fact[at[found]]
        return out

    def levels(firsts: np.ndarray, pairs: np.ndarray, segment: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        for (bits, sizes), low, high in zip((x.value for x in filters), bounds, bounds[1:], strict=False):
            some = np.flatnonzero((segment >= low) & (segment < high))
            starts, own = np.cumsum(sizes) - sizes, segment[some] - low
            some, own = some[sizes[own] > 0], own[sizes[own] > 0]
            out[some] = probe(bits, firsts[some], tag_of(pairs[some]), starts[own], sizes[own])
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_, hashes, rows in pieces(batch):
                n = docs_.num_rows
                firsts, pairs = pairs_of(hashes, rows)
                segment = segment_of(pairs, n_segments).astype(np.int64)
                here = (segment >= bounds[0]) & (segment < bounds[-1])
                # an end's counts are those of the starts; of a pass that isn't whole only its own tokens are looked at
                seen = np.arange(len(hashes)) if whole else np.flatnonzero(here)
                second = np.where(hashes[seen] == END, BEGIN, hashes[seen])
                kinds_, of = np.unique(second if whole else np.concatenate([second, firsts[seen]]), return_inverse=True)
                count, follow = looked_up(kinds_)
                if whole:  # the first of a pair is the token before, or the start, which the text's end stands for
                    before = np.where(firsts == BEGIN, np.searchsorted(kinds_, BEGIN), np.concatenate([[0], of[:-1]]))
                else:
                    of, before = of[: len(seen)], of[len(seen) :]
                own, context, spread = count[of], count[before], follow[before]
                single = (own + 0.5) / (tokens_ + 0.5 * (kinds + 1))
                sums = [np.bincount(rows, minlength=n), np.bincount(rows, own > 0, n).astype(np.int64), np.bincount(rows, np.log10(single), n)] if whole else [np.zeros(n, np.int64)] * 2 + [np.zeros(n)]
                level = np.zeros(len(seen), np.int64)
                ask = np.flatnonzero((own > 0) & (context > 0) & here[seen])
                level[ask] = levels(firsts[seen[ask]], pairs[seen[ask]], segment[seen[ask]])
                both = np.minimum(MEANS[level], np.minimum(own, context))
                score = np.log10((both + spread * single) / np.maximum(context + spread, 1), where=context > 0, out=np.log10(single))
                sums.append(np.bincount(rows[seen], np.where(here[seen], score, 0.0), n).astype(float))  # without tokens it has whole numbers
                yield pa.RecordBatch.from_arrays([*(docs_.column(c) for c in others), *map(pa.array, sums)], [*others, *_NAMES[1:]])

    kept = docs.select("text", *others)
    schema = StructType([*(kept.schema[c] for c in others), *_schema().fields[1:]])
    return cut_by_small_batches(kept.mapInArrow(work, schema))


def _broadcast_scores(docs: DataFrame, model: Model, n_passes: int = 1) -> DataFrame:
    """Scores by broadcasts, in passes over the texts that each have a group of segments. Rows of one id and text have one score, so these name a row in all passes."""
    context = docs.sparkSession.sparkContext
    if n_passes > 1:
        docs = docs.withColumns({"hash": F.xxhash64("text"), "bytes": F.octet_length("text")})
    keys = ["doc_id", "hash", "bytes"] if n_passes > 1 else ["doc_id"]
    vocabularies, scores = _broadcast_words(model, context), []
    n_parts = -(-model.filter_bytes // PART_BYTES) or 1
    for first in range(n_passes):
        low, high = (k * n_parts // n_passes for k in (first, first + 1))
        bounds = [k * model.n_segments // n_parts for k in range(low, high + 1)]
        filters = _broadcast_filters(model, context, bounds)
        scores.append(_pass(docs, model, vocabularies, filters, bounds, not first, keys))
        for part in filters:  # they are of no more use, and need not stay in memory
            part.destroy()
    for part in vocabularies:
        part.destroy()
    if n_passes == 1:
        return scores[0]
    sums = reduce(DataFrame.union, scores).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _NAMES[1:]])
    copies = F.col("n") / n_passes
    one = sums.select("doc_id", *[(F.col(c) / copies).cast(kind).alias(c) for c, kind in zip(_NAMES[1:], ("long", "long", "double", "double"), strict=True)], F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return one.select(*_NAMES)


_NAMES = ["doc_id", "n_tokens", "n_known", "base_score", "score"]


def _schema() -> StructType:
    return StructType.fromDDL("doc_id long, n_tokens long, n_known long, base_score double, score double")


def _met(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to their ``facts`` (keys, uses, any others); keys in many rows, of a bounded number, by broadcast."""
    hot = F.col("uses") * HOT_SHARE >= (facts.agg(F.sum("uses")).first()[0] or 0)
    common = facts.where(hot).drop("uses")
    plain = rows.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(facts.where(~hot).drop("uses"), keys)
    return rows.join(F.broadcast(common), keys).unionByName(plain)


def _shuffled_scores(docs: DataFrame, model: Model) -> DataFrame:
    n_segments = model.n_segments

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_, hashes, rows in pieces(batch):
                firsts, pairs = pairs_of(hashes, rows)
                order = np.lexsort((pairs, rows))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(rows[order]) != 0) | (pairs[order][1:] != pairs[order][:-1])]))
                at, n = order[new], np.diff(np.append(new, len(order)))
                second = np.where(hashes[at] == END, BEGIN, hashes[at])  # an end's counts are those of the starts
                columns = [*(x.view(np.int64) for x in (firsts[at], second, tag_of(pairs[at]))), segment_of(pairs[at], n_segments).astype(np.int32), n]
                yield pa.RecordBatch.from_arrays([*(docs_.column(c).take(pa.array(rows[at])) for c in ("row", "doc_id")), *map(pa.array, columns)], ["row", "doc_id", "first", "second", "tag", "segment", "n"])

    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(split, "row long, doc_id long, first long, second long, tag long, segment int, n long"))
    used = rows.select(F.explode(F.array("first", "second")).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    none = F.lit(0).cast("long")
    words_ = cut(used.join(model.words, "word", "left").select("word", "uses", F.coalesce("count", none).alias("count"), F.coalesce("followers", none).alias("followers")))
    asked = rows.groupBy("segment", "first", "tag").agg(F.count("*").alias("uses"))

    def answer(pairs: pa.Table, segment: pa.Table) -> pa.Table:
        level = np.zeros(len(pairs), np.int64)
        if len(segment) and len(pairs):
            bits = np.frombuffer(segment.column("bits")[0].as_py(), np.uint64)
            start = np.zeros(len(pairs), np.uint64)
            level = probe(bits, pairs.column("first").to_numpy().view(np.uint64), pairs.column("tag").to_numpy().view(np.uint64), start, start + np.uint64(len(bits)))
        return pa.Table.from_arrays([*(pairs.column(c) for c in ("segment", "first", "tag", "uses")), pa.array(MEANS[level])], ["segment", "first", "tag", "uses", "both"])

    pairs = cut(asked.groupBy("segment").cogroup(model.segments.groupBy("segment")).applyInArrow(answer, "segment int, first long, tag long, uses long, both double"))
    met = _met(rows, pairs, ["segment", "first", "tag"])
    met = _met(met, words_.select(F.col("word").alias("first"), "uses", F.col("count").alias("context"), F.col("followers").alias("spread")), ["first"])
    met = _met(met, words_.select(F.col("word").alias("second"), "uses", F.col("count").alias("own")), ["second"])
    single = (F.col("own") + 0.5) / (model.tokens + 0.5 * (model.kinds + 1))
    both = F.when((F.col("own") > 0) & (F.col("context") > 0), F.least("both", F.least("own", "context").cast("double"))).otherwise(0.0)
    share = F.when(F.col("context") > 0, (both + F.col("spread") * single) / (F.col("context") + F.col("spread"))).otherwise(single)
    sums = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("own") > 0, F.col("n")).otherwise(none)).alias("n_known"), F.sum(F.col("n") * F.log10(single)).alias("base_score"), F.sum(F.col("n") * F.log10(share)).alias("score"))
    return sums.select(*_NAMES)


def score_documents(docs: DataFrame, held_out: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``held_out``, a condition on doc_id, is false. Tokens are the words of a
    text with A-Z in lower case, then one end. n_known counts those that training texts hold. base_score is
    the sum of log10 shares of the tokens by themselves, half a count added to each and to the unknown; score sums
    the log10 of the mixed shares; where the first word of a pair is unknown it has the share of the second alone. Null texts
    are empty and have one token; repeated rows and ids count and are scored each; texts of any length are scored whole.
    Without training rows every token is unknown, of a share of one. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = fit(docs.where(~held_out))
    n_passes = model.passes(broadcast_bytes)
    scores = _broadcast_scores(docs, model, n_passes) if 0 < n_passes <= MOST_PASSES else _shuffled_scores(docs, model)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
