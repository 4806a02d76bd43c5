"""Removal of long repeated passages by difference-cover blockwise suffix grouping.

Suffixes are ordered on their first ``width`` bytes only, for that is all that decides
whether a ``width``-byte string starts anywhere else.

1.  A difference cover D modulo v is laid over every text: positions p with p mod v in D.
    For any two positions i, j there is a shift d < v with i+d and j+d both covered.
    The covered suffixes are named by their first ``width - v + 1`` bytes, one name bucket at
    a time; a name that several covered suffixes carry is *shared*.
2.  Two suffixes that agree on ``width`` bytes have a shared covered suffix at the same shift
    d < v. A suffix without one is settled by these names alone. The rest, the long ties,
    are dealt to suffix buckets by their first ``BUCKET_BYTES`` bytes.
3.  Each bucket is sorted alone by the 64-bit digest of its suffixes' first ``width`` bytes;
    equal neighbours are repeats. A task never holds more than one bucket or one chunk of texts.

Texts go through one shuffle, by chunk of ids. Buckets receive packed digests, each once a
chunk (a passage in a third of all texts sends one entry a chunk), and answer with one bit
each, so nothing of text length travels twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.common import BYTE_CODE, blocks, prefix_hash, span_hash, text_buffer

#: Cyclic difference cover: every residue modulo COVER_PERIOD is a difference of two elements. Fixed values.
COVER_PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
BUCKET_BYTES = 32
#: Text bytes of a chunk, the unit that one task handles at a time, and of the pieces it hashes at once.
CHUNK_BYTES = 8 << 20
PIECE_BYTES = 2 << 20
#: Bytes of packed digests that a bucket is planned for.
BUCKET_TARGET = 8 << 20

NOTE = "chunk int, kind int, bucket int, ref long, num long, payload binary"
NOTE_ARROW = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("ref", pa.int64()), ("num", pa.int64()), ("payload", pa.binary())])
UNIT, NAMES, TIES = 0, 1, 2

RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


class Chunk:
    """The texts of one chunk, with what the notes for it say."""

    def __init__(self, docs: pa.Table, notes: pa.Table, width: int, name_buckets: int, tie_buckets: int) -> None:
        self.width, self.name_buckets, self.tie_buckets = width, name_buckets, tie_buckets
        self.ids = docs.column("doc_id").to_pylist()
        self.data, self.offsets = text_buffer(docs.column("text"))
        self.notes = notes.to_pylist()
        units = {(x["ref"], x["payload"]): x["num"] for x in self.notes if x["kind"] == UNIT}
        self.copied, self.rows = np.zeros(len(self.ids), bool), []
        for row, doc_id in enumerate(self.ids):
            if self.offsets[row + 1] - self.offsets[row] >= width:
                copies = units.pop((doc_id, hashlib.sha256(self.data[self.offsets[row] : self.offsets[row + 1]]).digest()), None)
                self.copied[row] = copies != 1
                if copies:
                    self.rows.append(row)
        self._codes: list[np.ndarray] = []

    def pieces(self):
        """Row numbers, local offsets and prefix hashes of one piece of the texts after another."""
        lengths = np.array([self.offsets[r + 1] - self.offsets[r] for r in self.rows], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        for a, b in blocks(offsets, PIECE_BYTES):
            rows = self.rows[a:b]
            data = np.concatenate([self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows])
            yield rows, offsets[a : b + 1] - offsets[a], prefix_hash(BYTE_CODE[data])

    def covered(self, local: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Covered positions of a piece and the codes of their names: bucket above 31 bits of digest."""
        named = self.width - COVER_PERIOD + 1
        found = []
        for start, end in zip(local[:-1], local[1:], strict=True):
            for residue in COVER:
                found.append(np.arange(start + residue, end - named + 1, COVER_PERIOD))
        at = np.sort(np.concatenate(found))
        digest = span_hash(prefix, at, at + named)
        return at, ((digest >> np.uint64(32)) % np.uint64(self.name_buckets) << np.uint64(31)) | (digest & np.uint64(0x7FFFFFFF))

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct name codes of the chunk, and whether a code stands here more than once."""
        self._codes = [self.covered(local, prefix)[1] for _, local, prefix in self.pieces()]
        codes, counts = np.unique(np.concatenate(self._codes or [np.zeros(0, np.uint64)]), return_counts=True)
        return codes, counts > 1

    def answer(self, kind: int) -> np.ndarray:
        """The buckets' bits for what this chunk sent them, in order of bucket."""
        rows = sorted((x for x in self.notes if x["kind"] == kind), key=lambda x: x["bucket"])
        bits = [np.unpackbits(np.frombuffer(x["payload"], np.uint8), count=x["num"]) for x in rows]
        return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)

    def ties(self):
        """Of each piece: rows, local offsets, and the long ties' positions, suffix buckets and digests."""
        codes, _ = self.names()
        shared = self.answer(NAMES)
        for (rows, local, prefix), own in zip(self.pieces(), self._codes, strict=True):
            at, _ = self.covered(local, prefix)
            at = at[shared[np.searchsorted(codes, own)]]
            doc = np.searchsorted(local, at, side="right") - 1
            low = np.maximum(local[doc], at - COVER_PERIOD + 1)
            high = np.minimum(at, local[doc + 1] - self.width)
            fits = low <= high
            change = np.bincount(low[fits], minlength=prefix.shape[1] + 1) - np.bincount(high[fits] + 1, minlength=prefix.shape[1] + 1)
            at = np.flatnonzero(np.cumsum(change))
            bucket = (span_hash(prefix, at, at + BUCKET_BYTES) >> np.uint64(8)) % np.uint64(self.tie_buckets)
            yield rows, local, at, bucket.astype(np.uint32), span_hash(prefix, at, at + self.width) >> np.uint64(1)

    def tied(self):
        """All long ties of the chunk: pieces, then distinct digests in order of (bucket, digest), their
        buckets, whether they stand here more than once, and each tie's place among them."""
        pieces = list(self.ties())
        bucket = np.concatenate([x[3] for x in pieces] or [np.zeros(0, np.uint32)])
        digest = np.concatenate([x[4] for x in pieces] or [np.zeros(0, np.uint64)])
        order = np.argsort(digest, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        digest, bucket = digest[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return pieces, digest[first], bucket[first], np.diff(np.append(first, len(order))) > 1, place


def _packed(chunk: int, kind: int, bucket: np.ndarray, values: np.ndarray) -> pa.Table:
    """Notes for each bucket; ``bucket`` is sorted."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1 if len(bucket) else 0)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket)) if len(cuts) else cuts
    n = len(cuts)
    return pa.table(
        [pa.array(np.full(n, chunk, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(bucket[cuts].astype(np.int32)), pa.nulls(n, pa.int64()), pa.array((ends - cuts).astype(np.int64)), pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())],
        schema=NOTE_ARROW,
    )


def _settle(notes: pa.Table, kind: int, dtype: type) -> pa.Table:
    """One bucket: sort all entries, mark the repeated ones, answer each chunk in its own order."""
    parts = [np.frombuffer(x, dtype) for x in notes.column("payload").to_pylist()]
    entries = np.concatenate(parts)
    order = np.argsort(entries >> dtype(1), kind="stable")
    values = entries[order] >> dtype(1)
    same = values[1:] == values[:-1]
    repeated = np.zeros(len(entries), bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    repeated |= (entries & dtype(1)).astype(bool)
    cuts = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(repeated[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([notes.column("chunk"), pa.array(np.full(len(parts), kind, np.int32)), notes.column("bucket"), notes.column("ref"), notes.column("num"), pa.array(bits, pa.binary())], schema=NOTE_ARROW)


def chunk_of(doc_id: Column, mark: Column, chunks: int) -> Column:
    """Chunk of a document by its id and a hash of its text, so that rows without ids are spread, too."""
    return F.pmod(F.xxhash64(doc_id, mark), F.lit(chunks)).cast("int")


def repeated_spans(docs: DataFrame, width: int = 200) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, spans (maximal removed byte
    ranges of the input) and kept (the other bytes, concatenated).

    A byte goes if a ``width``-byte string over it also starts anywhere else in the table, the same
    text included; overlaps count, and matches never cross texts. Null text counts as empty; texts
    shorter than ``width`` keep everything; repeated rows are separate documents, so long ones lose
    all. Other columns are ignored. An empty table gives an empty result.
    """
    if not COVER_PERIOD < width:
        raise ValueError(f"width must exceed {COVER_PERIOD}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    chunks = max(partitions, total // CHUNK_BYTES + 1)
    name_buckets = max(partitions, total * len(COVER) // COVER_PERIOD * 4 // BUCKET_TARGET + 1)
    tie_buckets = max(partitions, total // 4 * 8 // BUCKET_TARGET + 1)
    units = (
        docs.where(F.octet_length("text") >= width)
        .select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("payload"), F.xxhash64("text").alias("mark"))
        .groupBy("payload")
        .agg(F.min("doc_id").alias("ref"), F.count("*").alias("num"), F.min("mark").alias("mark"))
        .select(chunk_of(F.col("ref"), F.col("mark"), chunks).alias("chunk"), F.lit(UNIT).alias("kind"), F.lit(0).alias("bucket"), "ref", "num", "payload")
    )
    texts = docs.withColumn("chunk", chunk_of(F.col("doc_id"), F.xxhash64("text"), chunks)).repartition(chunks, "chunk")

    def open_chunk(left: pa.Table, right: pa.Table) -> tuple[int, Chunk]:
        owner = (left if left.num_rows else right).column("chunk")[0].as_py()
        return owner, Chunk(left, right, width, name_buckets, tie_buckets)

    def name_covered(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, own = open_chunk(left, right)
        codes, many = own.names()
        return _packed(owner, NAMES, (codes >> np.uint64(31)).astype(np.int64), ((codes & np.uint64(0x7FFFFFFF)) << np.uint64(1) | many.astype(np.uint64)).astype(np.uint32))

    def deal_ties(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, own = open_chunk(left, right)
        _, digest, bucket, many, _ = own.tied()
        return _packed(owner, TIES, bucket.astype(np.int64), digest << np.uint64(1) | many.astype(np.uint64))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        _, own = open_chunk(left, right)
        pieces, _, _, _, place = own.tied()
        repeats, done, spans = own.answer(TIES), 0, {}
        for rows, local, at, _, _ in pieces:
            hit = at[repeats[place[done : done + len(at)]]]
            done += len(at)
            change = np.bincount(hit, minlength=local[-1] + 1) - np.bincount(hit + width, minlength=local[-1] + 1)
            covered = np.cumsum(change) > 0
            for row, a, b in zip(rows, local[:-1], local[1:], strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].view(np.int8), [0]])))
                spans[row] = edges.reshape(-1, 2)
        out = []
        for row, doc_id in enumerate(own.ids):
            data = own.data[own.offsets[row] : own.offsets[row + 1]]
            gone = np.array([[0, len(data)]]) if own.copied[row] else spans.get(row, np.zeros((0, 2), np.int64))
            ends = [0, *gone.reshape(-1).tolist(), len(data)]
            kept = b"".join(data[a:b].tobytes() for a, b in zip(ends[::2], ends[1::2], strict=True))
            out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data) - len(kept), "spans": [{"start": a, "end": b} for a, b in gone.tolist()], "kept": kept})
        return pa.Table.from_pylist(out, schema=RESULT_ARROW)

    def with_texts(notes: DataFrame, work, schema: str) -> DataFrame:
        return texts.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(work, schema)

    def settled(entries: DataFrame, kind: int, dtype: type) -> DataFrame:
        return entries.groupBy("bucket").applyInArrow(lambda x: _settle(x, kind, dtype), NOTE)

    names = settled(with_texts(units, name_covered, NOTE), NAMES, np.uint32)
    ties = settled(with_texts(units.unionByName(names), deal_ties, NOTE), TIES, np.uint64)
    return with_texts(units.unionByName(names).unionByName(ties), remove, RESULT)
