"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case; numbers, units behind numbers and names (capitalised words)
become typed placeholders. A capitalised word at the start of a sentence may be a name or not and counts as
both; besides, each window has a form with all names as words, for copies in another case, and a document's also one
with those names as words that the benchmark has as ordinary words, for copies in title case with other names. All windows of
``WINDOW`` such tokens of the benchmark stand in a table by hash, and the documents' windows are joined to it; a
window of slots only is joined by its very values, as all such windows look alike. Matches of one item at the same
shift that leave no token between them form a stretch, and in it a run goes as far as the slots agree: one value of the benchmark always stands for one value of the document and the other way round. A
document is contaminated by a run of ``RUN`` words, or of a whole shorter item, with ``LEAST_WORDS`` ordinary
words (or all that a shorter item has, at least one) or the item's very values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm.common import BYTE_CODE, blocks, cut, lower_bytes, mix, prefix_hash, span_hash, text_buffer, words

WINDOW, RUN = 8, 13
#: A run with fewer ordinary words counts only if its slots hold the very values of the benchmark.
LEAST_WORDS = 4
#: Forms of windows that are worked out at once.
FORMS_AT_ONCE = 1 << 21
#: Bits a benchmark window has in the filter that goes to all tasks, and the logarithm of the most bits (64 MB): beyond
#: that the filter lets more windows through to the join, which decides alone.
FILTER_BITS, MOST_BITS = 16, 29
PIECE_BYTES = 2 << 20
#: Units that become placeholders behind a number. Fixed values.
UNITS = "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg lb lbs pound pounds oz ounce ounces t ton tons tonne tonnes ml cl dl l liter liters litre litres gal gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % $ usd dollar dollars eur euro euros gbp c f k degree degrees mph kph hz khz mhz ghz w kw kwh v a n j pa bar"
WORD, NUMBER, UNIT, NAME = range(4)
#: Tells hashes of values from those of templates.
_SLOTS = np.uint64(0x5DEECE66D1234567)
_PLACEHOLDER = mix(np.array([100, 101, 102, 103], np.uint64))

_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_CORE = _DIGIT | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128) | (_BYTES == 36) | (_BYTES == 37)
_STOP = np.isin(_BYTES, np.frombuffer(b".!?:\n", np.uint8))


def _hash_words(texts: list[str]) -> np.ndarray:
    data, offsets = text_buffer(pa.array(texts))
    return span_hash(prefix_hash(BYTE_CODE[data]), offsets[:-1], offsets[1:])


def _hashed(at: np.ndarray, length: int, codes: np.ndarray) -> np.ndarray:
    """Hashes of windows by the given codes of their tokens."""
    hashes = np.full(len(at), length, np.uint64)
    for k in range(length):
        hashes = mix(hashes + codes[at + k])
    return hashes


class Tokens:
    """Canonical tokens of all rows of a buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, rows = words(data, offsets)
        core = _CORE[data]
        at = np.arange(len(data))
        following = np.minimum.accumulate(np.where(core, at, len(data))[::-1])[::-1] if len(data) else at
        last = np.maximum.accumulate(np.where(core, at, -1)) if len(data) else at
        begin, end = following[starts] if len(starts) else starts, last[ends - 1] + 1 if len(ends) else ends
        real = begin < np.minimum(end, ends)
        begin, end, rows = begin[real], end[real], rows[real]
        self.rows, self.value = rows, span_hash(prefix_hash(BYTE_CODE[lower_bytes(data)]), begin, end)
        first, second = data[begin], data[np.minimum(begin + 1, end - 1)]
        number = _DIGIT[first] | ((first == 36) & _DIGIT[second])
        follows = np.zeros(len(rows), bool)
        follows[1:] = rows[1:] == rows[:-1]
        unit = np.zeros(len(rows), bool)
        unit[1:] = number[:-1] & ~number[1:] & np.isin(self.value[1:], _UNIT_VALUES)
        unit &= follows
        name = ((first >= 65) & (first <= 90) & ~((second >= 65) & (second <= 90))) | ((first == 0xC3) & (second <= 0x9E))
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD))).astype(np.int8)
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        begins = ~follows
        begins[1:] |= stops[begin[1:]] > stops[end[:-1]]
        self.either = (self.kind == NAME) & begins
        self.counts = np.bincount(rows, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.ordinary = np.bincount(rows, self.kind == WORD, len(offsets) - 1).astype(np.int64)
        self.template = np.where(self.kind == WORD, self.value, _PLACEHOLDER[self.kind])
        self.said = np.where(self.kind == NAME, self.value, self.template)

    def windows(self, length: int, known: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First tokens and hashes of all windows of ``length`` tokens, in all forms. ``known`` gives the indices of those
        word hashes that the other side has as ordinary words."""
        at = np.arange(len(self.rows))
        at = at[at + length <= self.first[self.rows + 1]] if len(at) else at
        if not len(at):
            return
        either, names, ordinary = (np.concatenate([[0], np.cumsum(x)]) for x in (self.either, (self.kind == NAME) & ~self.either, self.kind == WORD))
        title = np.zeros(len(self.rows), bool)
        if known:
            capital = np.flatnonzero(self.kind == NAME)
            title[capital[known(self.value[capital])]] = True
        titled, other = (np.concatenate([[0], np.cumsum(x)]) for x in (title, (self.kind == NAME) & ~title))
        cased = np.where(title, self.value, self.template)
        forms = np.cumsum(1 << (either[at + length] - either[at]))
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(forms, (forms[low - 1] if low else 0) + FORMS_AT_ONCE, side="right")))
            own = at[low:high]
            said = ordinary[own + length] > ordinary[own]
            hashes = np.full(len(own), length, np.uint64)
            for k in range(length):
                code, both = self.template[own + k], np.flatnonzero(self.either[own + k])
                if len(both):
                    code = np.concatenate([code, self.value[own[both] + k]])
                    own, hashes = np.concatenate([own, own[both]]), np.concatenate([hashes, hashes[both]])
                    said = np.concatenate([said, np.ones(len(both), bool)])
                hashes = mix(hashes + code)
            slots = np.flatnonzero(~said)
            hashes[slots] = _hashed(own[slots], length, self.value) ^ _SLOTS
            yield own, hashes
            own = at[low:high]
            own = own[names[own + length] > names[own]]
            yield own, _hashed(own, length, self.said)
            own = at[low:high]
            own = own[(titled[own + length] > titled[own]) & (other[own + length] > other[own])]
            yield own, _hashed(own, length, cased)
            low = high


_UNIT_VALUES = _hash_words(UNITS.split())
_SEEN = "position long, length int, hash long, values array<long>, kinds array<tinyint>"


def _seen(tokens: Tokens, at: np.ndarray, hashes: np.ndarray, length: int) -> list[pa.Array]:
    """Columns of _SEEN for windows."""
    places = (at[:, None] + np.arange(length)).ravel()
    edges = pa.array(np.arange(len(at) + 1, dtype=np.int32) * length)
    lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (tokens.value[places].view(np.int64), tokens.kind[places])]
    return [pa.array(at - tokens.first[tokens.rows[at]]), pa.array(np.full(len(at), length, np.int32)), pa.array(hashes.view(np.int64)), *lists]


_SEEN_NAMES = ["position", "length", "hash", "values", "kinds"]


def _benchmark_windows(items: DataFrame) -> DataFrame:
    """Windows of ``items`` (item, item_id, text), each of an item's own length, with its numbers of tokens and of ordinary words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in blocks(offsets, PIECE_BYTES):
                tokens = Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for length in sorted({min(WINDOW, int(c)) for c in tokens.counts if c}):
                    for at, hashes in tokens.windows(length):
                        own = np.minimum(WINDOW, tokens.counts[tokens.rows[at]]) == length
                        at, hashes = at[own], hashes[own]
                        rows = tokens.rows[at]
                        kept = [batch.column(c).take(pa.array(a + rows)) for c in ("item", "item_id")]
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(tokens.counts[rows]), pa.array(tokens.ordinary[rows]), *_seen(tokens, at, hashes, length)], ["item", "item_id", "tokens", "ordinary", *_SEEN_NAMES])

    return items.mapInArrow(work, f"item long, item_id long, tokens long, ordinary long, {_SEEN}")


def _filter_of(windows: DataFrame) -> tuple[np.ndarray, int]:
    """Bits set for each hash, and for each ordinary word in ``windows``, at two places, of at most 2**MOST_BITS, and the logarithm of their number."""
    said = windows.select(F.explode(F.arrays_zip("values", "kinds")).alias("token")).where(F.col("token.kinds") == WORD).select(F.col("token.values").alias("hash")).distinct()
    windows = windows.select("hash").union(said)
    bits = min(MOST_BITS, max(16, (FILTER_BITS * windows.count()).bit_length()))
    place = F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.shiftrightunsigned(F.shiftleft("hash", 32), 64 - bits))).alias("place")
    found = windows.select(place).groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out, bits


def _passes(found: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter lets through."""
    test = lambda x: (found[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)
    some = np.flatnonzero(test(hashes >> np.uint64(64 - bits)))
    return some[test(hashes[some] << np.uint64(32) >> np.uint64(64 - bits))]


def _document_windows(texts: DataFrame, lengths: list[int], shared) -> DataFrame:
    """Windows of ``texts`` (key, text) of the given lengths that the filter lets through."""
    passes = _passes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in blocks(offsets, PIECE_BYTES):
                tokens = Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for length in lengths:
                    for at, hashes in tokens.windows(length, lambda words_: passes(*shared.value, words_)):
                        some = passes(*shared.value, hashes)
                        if len(some):
                            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(a + tokens.rows[at[some]])), *_seen(tokens, at[some], hashes[some], length)], ["key", *_SEEN_NAMES])

    return texts.mapInArrow(work, f"key string, {_SEEN}")


def longest_run(theirs: list[tuple[int, int]], mine: list[tuple[int, int]], needed: int) -> int:
    """Tokens of the longest part of two matching stretches, as (value, kind), whose slots agree and that says enough."""
    ordinary, start, same, most = [0], 0, 0, 0
    there: dict[int, tuple[int, int]] = {}
    back: dict[int, tuple[int, int]] = {}
    for k, ((a, kind), (b, kind_b)) in enumerate(zip(theirs, mine, strict=True)):
        slot = kind != WORD and kind == kind_b
        ordinary.append(ordinary[-1] + (not slot))
        if slot:
            for seen, x, y in ((there, a, b), (back, b, a)):
                if x in seen and seen[x][0] != y:
                    start = max(start, seen[x][1] + 1)
                seen[x] = (y, k)
            if a != b:
                same = k + 1
        if ordinary[k + 1] - ordinary[start] >= needed:
            most = max(most, k + 1 - start)
        most = max(most, k + 1 - same)
    return most


def _longest(stretches: DataFrame) -> DataFrame:
    """(key, item, item_id, run) of ``stretches`` (key, item, item_id, tokens, ordinary, windows in order) with a long enough run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(windows: list[dict], values: str, kinds: str) -> list[tuple[int, int]]:
            """A stretch's tokens: of each window those in front of the next one."""
            counts = [b["position"] - a["position"] for a, b in zip(windows, windows[1:], strict=False)] + [None]
            return [x for w, n in zip(windows, counts, strict=True) for x in list(zip(w[values], w[kinds], strict=True))[:n]]

        for batch in batches:
            runs = []
            for x in batch.select(["tokens", "ordinary", "windows"]).to_pylist():
                run = longest_run(joined(x["windows"], "item_values", "item_kinds"), joined(x["windows"], "values", "kinds"), min(LEAST_WORDS, max(1, x["ordinary"])))
                runs.append(run if run >= min(RUN, x["tokens"]) else None)
            found = pa.array(runs, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "item", "item_id")], found], ["key", "item", "item_id", "run"]).filter(found.is_valid())

    return stretches.mapInArrow(work, "key string, item long, item_id long, run long")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, run_words, item_id) of the contaminated ones among ``docs`` (key, text), one row a key."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0").distinct()
    known = cut(_benchmark_windows(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")).dropDuplicates(["item", "position", "hash"]))
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # at most WINDOW values
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(known))
    theirs = known.select("item", "item_id", "tokens", "ordinary", "length", "hash", F.col("position").alias("item_position"), F.col("values").alias("item_values"), F.col("kinds").alias("item_kinds"))
    hits = _document_windows(docs, lengths, shared).dropDuplicates(["key", "position", "hash"]).join(theirs, ["length", "hash"]).withColumn("shift", F.col("position") - F.col("item_position"))
    hits = hits.dropDuplicates(["key", "item", "shift", "position"])
    # windows that overlap or touch leave no token out, so slots between them need no window of their own
    order = Window.partitionBy("key", "item", "shift").orderBy("position")
    hits = hits.withColumn("apart", F.coalesce(F.col("position") - F.lag("position").over(order) > F.col("length"), F.lit(False)).cast("int"))
    stretch = F.sum("apart").over(order)
    windows = F.sort_array(F.collect_list(F.struct("position", "values", "kinds", "item_values", "item_kinds"))).alias("windows")
    same = ["key", "item", "item_id", "tokens", "ordinary", "length", "shift", "stretch"]
    stretches = hits.withColumn("stretch", stretch).groupBy(*same).agg(windows).where(f"element_at(windows, -1).position - windows[0].position + length >= least({RUN}L, tokens)")
    best = F.min(F.struct((-F.col("run")).alias("run"), F.col("item_id").isNull().alias("no_id"), "item_id")).alias("best")
    return _longest(stretches).groupBy("key").agg(best).select("key", (-F.col("best.run")).alias("run_words"), "best.item_id")


def mark_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (text, any others) with contaminated, item_id and run_words.

    item_id is the benchmark item (item_id, text) of the longest run, null for clean rows; among equal
    runs the smallest id, null last. Null and empty texts, of documents or items, match nothing. Items of
    fewer than WINDOW tokens match as a whole. Repeated rows are judged each, and equal texts alike; input
    columns named like the new ones are replaced. Neither the benchmark nor the matches pass through the
    driver, but for a filter of bounded size; matches are joined to the rows by an MD5 of the text.
    """
    docs = docs.drop("contaminated", "item_id", "run_words", "_key").withColumn("_key", F.md5(F.col("text").cast("string").cast("binary")))
    found = cut(matches(docs.select(F.col("_key").alias("key"), F.col("text").cast("string").alias("text")).where("length(text) > 0"), benchmark))
    marked = docs.join(found.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    return marked.withColumns({"run_words": F.coalesce("run_words", F.lit(0).cast("long")), "contaminated": F.col("run_words").isNotNull()})
