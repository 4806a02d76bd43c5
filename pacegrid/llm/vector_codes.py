"""Vector code compression by product quantisation; the codebooks are fitted to all vectors by heap Lloyd.

Vectors become integers and are cut into parts; every part position has a codebook of ``ENTRIES`` entries.
Vectors stand in blocks, one row each, and every block keeps a heap per part position and entry: the entry's
parts, keyed by lower minus upper bound, that is by how much farther than their own entry the next one may be.
When entries move, no key is touched: what an entry and the farthest-moving other one moved, summed over the
rounds, is the slack that all of its parts have lost. Only parts whose key is below that sum are
popped and compared with all entries again, in exact integers; they are pushed back with a new key, to which
the sum so far is added. A heap is kept as an ascending run, which is one: popping cuts off its front, found by
binary search. A round is one pass over the blocks, without a shuffle; it writes the blocks to the
shared folder, with what popped parts changed in the entries' sums. Only these sums, one a codebook
component, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.common import cut, discard

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bytes of integers that a block holds at most, besides its last vector.
BLOCK_BYTES = 2 << 20
#: Keys and sums of moves are rounded to this many units of distance, always so that more is rescanned.
MARGIN = 1e-3
#: Labels whose sums are broadcast to the rows; more are joined by shuffle.
BROADCAST_LABELS = 100_000
_BLOCK = "vec_ids binary, no_id binary, labels binary, no_label binary, vectors binary, entries binary, heap_rows binary, heap_keys binary, heap_sizes binary, rescanned long, sums array<long>"
_FIELDS = [x.split()[0] for x in _BLOCK.split(", ")]


def bound(dimension: int) -> int:
    """The largest integer component, so that a vector's error fits into 62 bits; larger ones are clamped to it."""
    return 1 << ((62 - max(1, dimension - 1).bit_length()) // 2 - 1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding, label) whose vector is neither null nor empty and has finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label")).where((F.size("embedding") > 0) & finite)


def edges_of(dimension: int) -> list[int]:
    """First components of the parts, and the dimension."""
    return [k * dimension // PARTS for k in range(PARTS + 1)]


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each part (row) to each entry, in exact integers."""
    out = np.zeros((len(parts), len(entries)), np.int64)
    for component, ours in zip(parts.T, entries.T, strict=True):
        apart = component.astype(np.int64)[:, None] - ours[None, :]
        out += apart * apart
    return out


class Codebooks:
    """All entries of a round, with the moves summed up to it."""

    def __init__(self, books: list[np.ndarray], lost: np.ndarray) -> None:
        self.books, self.lost = books, lost

    def moved_to(self, books: list[np.ndarray]) -> Codebooks:
        """The next round's: entry e's parts lose what e and the farthest-moving other entry moved."""
        lost = self.lost.copy()
        for part, (old, new) in enumerate(zip(self.books, books, strict=True)):
            moves = np.sqrt(((new - old) ** 2).sum(1).astype(float))
            for e in range(len(moves)):
                lost[part, e] += moves[e] + max(np.delete(moves, e), default=0.0) + MARGIN
        return Codebooks(books, lost)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


class Block:
    """Vectors with the state of their parts; entries and the sums' changes are kept per part position."""

    def __init__(self, row: dict, dimension: int) -> None:
        self.row, self.edges = row, edges_of(dimension)
        self.vectors = np.frombuffer(row["vectors"], np.int16 if row["narrow"] else np.int64).reshape(-1, dimension)
        n = len(self.vectors)
        self.entries = np.frombuffer(row["entries"], np.uint8).reshape(PARTS, n).copy() if row["entries"] else None
        if row["heap_rows"]:
            self.sizes = np.frombuffer(row["heap_sizes"], np.int64).reshape(PARTS, -1)
            self.rows, self.keys = (np.frombuffer(row[name], kind).reshape(PARTS, n) for name, kind in (("heap_rows", np.uint32), ("heap_keys", np.float64)))

    def part(self, k: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.vectors[rows, self.edges[k] : self.edges[k + 1]]

    def rescan(self, now: Codebooks) -> dict:
        """Pop the parts whose slack is used up, compare them with all entries, and push them back; the block's next row."""
        n, sums, rescanned = len(self.vectors), [], 0
        first = self.entries is None
        entries = np.zeros((PARTS, n), np.uint8) if first else self.entries
        out_rows, out_keys, out_sizes = [], [], []
        for k, book in enumerate(now.books):
            if first:
                popped, stay = np.arange(n), [(np.zeros(0, np.uint32), np.zeros(0))] * len(book)
            else:
                ends = np.cumsum(self.sizes[k])
                popped, stay = [], []
                for e, (a, b) in enumerate(zip(ends - self.sizes[k], ends, strict=True)):
                    front = a + int(np.searchsorted(self.keys[k, a:b], now.lost[k, e] + MARGIN, side="right"))
                    popped.append(self.rows[k, a:front])
                    stay.append((self.rows[k, front:b], self.keys[k, front:b]))
                popped = np.concatenate(popped).astype(np.int64)
            own = self.part(k, popped)
            apart = distances(own, book)
            best = apart.argmin(1)  # the first of equal ones
            upper = np.sqrt(np.take_along_axis(apart, best[:, None], 1)[:, 0].astype(float))
            np.put_along_axis(apart, best[:, None], np.iinfo(np.int64).max, 1)
            slack = np.sqrt(apart.min(1).astype(float)) - upper + now.lost[k, best]
            change = np.zeros((len(book), 1 + own.shape[1]), np.int64)
            moved = np.arange(len(popped)) if first else np.flatnonzero(entries[k, popped] != best)
            for to, sign in ((best[moved], 1), (entries[k, popped[moved]], -1)):
                if sign > 0 or not first:
                    np.add.at(change, to, sign * np.column_stack([np.ones(len(moved), np.int64), own[moved].astype(np.int64)]))
            sums.append(change.ravel())
            entries[k, popped] = best
            rescanned += len(popped)
            order = np.argsort(slack, kind="stable")
            by_entry = order[np.argsort(best[order], kind="stable")]
            edges = np.searchsorted(best[by_entry], np.arange(len(book) + 1))
            for e, (rows, keys) in enumerate(stay):
                new = by_entry[edges[e] : edges[e + 1]]
                at = np.searchsorted(keys, slack[new])
                out_rows.append(np.insert(rows, at, popped[new]).astype(np.uint32))
                out_keys.append(np.insert(keys, at, slack[new]))
                out_sizes.append(len(out_keys[-1]))
        state = {"entries": entries.tobytes(), "heap_rows": np.concatenate(out_rows).tobytes(), "heap_keys": np.concatenate(out_keys).tobytes(), "heap_sizes": np.array(out_sizes, np.int64).tobytes(), "rescanned": rescanned, "sums": np.concatenate(sums)}
        return {name: state.get(name, self.row.get(name)) for name in ["narrow", *_FIELDS]}


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in batch.schema.names if name not in ("sums", "rescanned")}


def _batch(row: dict) -> pa.RecordBatch:
    kinds = {"narrow": pa.bool_(), "rescanned": pa.int64(), "sums": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.binary())) for c in ("narrow", *_FIELDS)], ["narrow", *_FIELDS])


def _blocks(vectors: DataFrame, dimension: int, first: Codebooks) -> DataFrame:
    """Blocks of usable ``vectors``, in their first round: every part is popped."""
    most = bound(dimension)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_once = max(1, BLOCK_BYTES // (2 * dimension))
            for low in range(0, batch.num_rows, at_once):
                some = batch.slice(low, at_once)
                values = some.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                whole = np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)
                narrow = bool(np.abs(whole).max() < 1 << 15)
                row = {"narrow": narrow, "vectors": whole.astype(np.int16 if narrow else np.int64).tobytes(), "entries": None, "heap_rows": None}
                for name, none, column in (("vec_ids", "no_id", "vec_id"), ("labels", "no_label", "label")):
                    row |= {name: some.column(column).fill_null(0).to_numpy().tobytes(), none: some.column(column).is_null().to_numpy(zero_copy_only=False).tobytes()}
                yield _batch(Block(row, dimension).rescan(first))

    return vectors.mapInArrow(work, f"narrow boolean, {_BLOCK}")


def _round(blocks: DataFrame, dimension: int, now: Codebooks) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _batch(Block(row, dimension).rescan(now))

    return blocks.mapInArrow(work, f"narrow boolean, {_BLOCK}")


def _changes(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Changes of the counts and sums of each codebook's entries over all blocks: one number a component, whatever the table's size."""
    found = blocks.select(F.posexplode("sums").alias("at", "change")).groupBy("at").agg(F.sum("change").alias("change")).collect()
    flat = np.zeros(sum(book.size + len(book) for book in books), np.int64)
    for r in found:
        flat[r["at"]] = r["change"]
    out = []
    for book in books:
        own, flat = flat[: book.size + len(book)], flat[book.size + len(book) :]
        out.append(own.reshape(len(book), -1))
    return out


def fit(vectors: DataFrame) -> tuple[Codebooks, DataFrame | None, int]:
    """The final codebooks of usable ``vectors``, their blocks before the last assignment, and the dimension."""
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding", F.col("label").asc_nulls_first()).limit(1).collect()
    dimension = len(start[0]["embedding"]) if start else 0
    vectors = vectors.where(F.size("embedding") == dimension)
    start = vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect() if start else []
    if not start:
        return Codebooks([np.zeros((0, 0), np.int64)] * PARTS, np.zeros((PARTS, 0))), None, 0
    most, edges = bound(dimension), edges_of(dimension)
    whole = np.clip(np.floor(np.array([r["embedding"] for r in start]) * SCALE), -most, most).astype(np.int64)
    now = Codebooks([whole[:, a:b] for a, b in zip(edges, edges[1:], strict=False)], np.zeros((PARTS, len(whole))))
    totals = [np.zeros((len(book), 1 + book.shape[1]), np.int64) for book in now.books]
    blocks = cut(_blocks(vectors, dimension, now))
    for k in range(ROUNDS):
        totals = [a + b for a, b in zip(totals, _changes(blocks, now.books), strict=True)]
        now = now.moved_to([np.where(all_[:, :1] > 0, all_[:, 1:] // np.maximum(all_[:, :1], 1), book) for all_, book in zip(totals, now.books, strict=True)])
        if k + 1 < ROUNDS:
            before, blocks = blocks, cut(_round(blocks, dimension, now))
            discard(before)
    return now, blocks, dimension


def _coded(blocks: DataFrame, dimension: int, now: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of all vectors, after the last assignment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = Block(row, dimension)
                block.rescan(now)
                apart = sum(((block.part(k).astype(np.int64) - book[block.entries[k]]) ** 2).sum(1) for k, book in enumerate(now.books))
                digits = block.entries.T.copy().tobytes().hex()
                columns = [pa.array(np.frombuffer(row[name], np.int64), mask=np.frombuffer(row[none], bool)) for name, none in (("vec_ids", "no_id"), ("labels", "no_label"))]
                codes = [digits[a : a + 2 * PARTS] for a in range(0, len(digits), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(codes), pa.array(apart)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(work, "vec_id long, label long, code string, error long")


def compress(vectors: DataFrame) -> DataFrame:
    """Per usable row of ``vectors`` (vec_id, embedding, label): vec_id, label, code, error, label_error, codebooks_sha256.

    Left out are null and empty vectors, those with null or non-finite components, and those of another dimension than
    the row of the smallest vec_id has. Components beyond bound() after scaling are clamped, so that no sum
    overflows a vector's error. Ids: null ones are the last to start a codebook and ties go by the vector; fewer
    vectors than ENTRIES make fewer entries, and repeated rows count each. Dimensions that PARTS doesn't divide give parts
    that differ by one component. label_error is the errors' sum over equal labels, null being one; one beyond 63 bits is null.
    An empty table gives an empty result. Other columns are ignored.
    """
    kept = usable(vectors)
    now, blocks, dimension = fit(kept)
    if blocks is None:
        coded = vectors.limit(0).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = cut(_coded(blocks, dimension, now))
    errors = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.expr("try_cast(sum(cast(error as decimal(20, 0))) as bigint)").alias("label_error")))
    errors = F.broadcast(errors) if errors.count() <= BROADCAST_LABELS else errors
    return coded.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(now.digest()).alias("codebooks_sha256"))
