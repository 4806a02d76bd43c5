"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text's code points gives the hash of any span in constant time. A fingerprint
is the whole text's hash and the ``KEPT`` smallest hashes among all its ``SPAN`` code point spans: equal
texts have equal fingerprints, and two fingerprints estimate how much of their spans is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.common import POINTS, PRIME, mix, prefix_hash, span_hash, spliced

SPAN, KEPT = 16, 64
#: Text bytes that a range of ids is planned for, and ranges at most: the driver holds a bound and an id of each.
#: A task reads its range row by row, so larger ranges take longer but no more memory.
RANGE_BYTES, MOST_RANGES = 8 << 20, 50_000
#: Rows of the result that are handed on at once.
ROWS_AT_ONCE = 256
#: Ids looked at for each range when the ranges' bounds are chosen; these only share out the work.
IDS_A_RANGE = 20
_LAST = -(1 << 63)
#: Odd factor that spreads a text's length over its whole hash.
LENGTH_MARK = 0x9E3779B97F4A7C15

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start long"
_RESULT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("same_start", pa.int64())]
)


class PrefixHashes:
    """Span equality and longest common extensions of one text."""

    def __init__(self, prefix: np.ndarray) -> None:
        self.n, self.prefix = prefix.shape[1] - 1, prefix

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(prefix_hash(mix(points.astype(np.uint64) + np.uint64(1))))

    def edited(self, following: PrefixHashes) -> PrefixHashes:
        """Those of edited(): spliced from the prefix arrays of both texts, without reading them again."""
        third = self.n // 3
        return PrefixHashes(spliced(self.prefix, self.n - third, following.prefix, min(third, following.n)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end)."""
        return span_hash(self.prefix, start, end)

    def same(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        """Whether two spans are equal: their polynomials, each moved to where the other starts."""
        for point, own, theirs in zip(POINTS, self.prefix, other.prefix, strict=True):
            a, b = int(own[start + length]) - int(own[start]), int(theirs[other_start + length]) - int(theirs[other_start])
            if (a * pow(point, other_start, PRIME) - b * pow(point, start, PRIME)) % PRIME:
                return False
        return True

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common text from two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def smallest(self) -> np.ndarray:
        """The KEPT smallest distinct span hashes, sorted."""
        start = np.arange(max(1, self.n - SPAN + 1))
        found = self.spans(start, np.minimum(start + SPAN, self.n))
        if len(found) > 4 * KEPT:
            least = np.unique(np.partition(found, 2 * KEPT)[: 2 * KEPT])
            if len(least) >= KEPT:
                return least[:KEPT]
        return np.unique(found)[:KEPT]

    def fingerprint(self) -> tuple[int, np.ndarray]:
        """Hash of the whole text, and smallest()."""
        first, second = self.prefix[:, self.n].tolist()
        return ((first << 31 | second) ^ self.n * LENGTH_MARK) % (1 << 64), self.smallest()


def as_text(fingerprint: tuple[int, np.ndarray]) -> str:
    """Hexadecimal form."""
    return f"{fingerprint[0]:016x}:" + fingerprint[1].astype(">u8").tobytes().hex()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of spans in common, from 0 to 1 (Dice coefficient of the estimated Jaccard similarity); 1 for equal texts."""
    if a[0] == b[0]:
        return 1.0
    both = np.sort(np.concatenate([a[1], b[1]]))
    new = np.append(True, both[1:] != both[:-1])
    last = both[new][:KEPT][-1]  # the KEPT smallest of both; those that stand twice are in common
    similar = ((~new) & (both <= last)).sum() / min(int(new.sum()), KEPT)
    return float(2 * similar / (1 + similar))


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as much of ``following``, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and likenesses.

    The next document is the one with the next smaller doc_id, after the last the first; rows with
    equal ids stand in order of their texts, a null id comes last. Null text is empty. near_edited and
    near_next compare with the edited text's and the next document's fingerprint; same_start is how
    many code points text and edited text have in common from the start. A single row is its own next.
    Texts move once, to ranges of ids, and stand in order there; each range also gets the row after its last, of
    which every task that reads the table sends the first it has. Bounds come from a sample of at most about
    IDS_A_RANGE ids a range, whatever the table's size. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    ranges = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES + 1))
    ids_only = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"))
    looked_at = ids_only if n <= IDS_A_RANGE * ranges else ids_only.sample(IDS_A_RANGE * ranges / n, seed=8)
    cuts = looked_at.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], IDS_A_RANGE * ranges)).first()[0]
    bounds = np.unique(np.array(cuts or [0], np.int64))

    def range_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, ids, side="left").astype(np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column("doc_id").to_numpy())), batch.column("doc_id")], ["owner", "doc_id"])

    firsts = dict(ids_only.mapInArrow(number, "owner int, doc_id long").groupBy("owner").agg(F.max("doc_id")).collect())
    used = sorted(firsts)
    asks = {firsts[below]: above for below, above in zip(used, used[1:], strict=False)} | ({firsts[used[-1]]: used[0]} if used else {})
    asked = np.array(sorted(asks), np.int64)
    askers = np.array([asks[x] for x in asked.tolist()], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to their ranges, and of each id that another range asks for the first row here."""
        names, found = ["owner", "own", "doc_id", "text"], {}
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(range_of(ids)), pa.array(np.ones(len(ids), bool)), batch.column("doc_id"), batch.column("text")], names)
            at = np.minimum(np.searchsorted(asked, ids), len(asked) - 1)
            for k in np.flatnonzero(asked[at] == ids).tolist():
                row = (not batch.column("doc_id")[k].is_valid, batch.column("text")[k].as_py())
                found[int(at[k])] = min(row, found.get(int(at[k]), row))
        for k, (unknown, text) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([askers[k]], pa.int32()), pa.array([False]), pa.array([None if unknown else asked[k]], pa.int64()), pa.array([text], pa.string())], names)

    def result(doc_id: int, text: str, hashes: PrefixHashes, own: tuple[int, np.ndarray], following: str, next_hashes: PrefixHashes, after: tuple[int, np.ndarray]) -> dict:
        changed, new_hashes = edited(text, following), hashes.edited(next_hashes)
        new = new_hashes.fingerprint()
        return {
            "doc_id": doc_id,
            "n_chars": len(text),
            "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": as_text(own),
            "edited_fingerprint": as_text(new),
            "near_edited": likeness(own, new),
            "near_next": likeness(own, after),
            "same_start": hashes.common_extension(0, new_hashes, 0),
        }

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range come in order, then those of the next id; a row waits for the one behind it."""
        waiting, out = None, []
        for batch in batches:
            for owner, own, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("owner", "own", "doc_id", "text")], strict=True):
                if not own and waiting is None:
                    continue
                hashes = PrefixHashes.of(text)
                found = hashes.fingerprint()
                if waiting is not None and waiting[0] == owner:
                    out.append(result(*waiting[1:], text, hashes, found))
                    if len(out) >= ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(out, schema=_RESULT_ARROW)
                        out = []
                waiting = (owner, doc_id, text, hashes, found) if own else None
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT_ARROW)

    dealt = docs.mapInArrow(deal, "owner int, own boolean, doc_id long, text string").repartition(ranges, "owner")
    return dealt.sortWithinPartitions("owner", F.desc("own"), F.desc("doc_id"), "text").mapInArrow(compare, RESULT)
