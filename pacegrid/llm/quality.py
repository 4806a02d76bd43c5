"""Quality classifier: Gaussian-kernel ridge regression by random Fourier features, then isotonic calibration.

A text becomes some twenty statistics; random cosines of them approximate a Gaussian kernel. Every
partition of a bounded sample of labelled rows sums its part of the normal equations, the sums are added up
in two steps, and only the final matrices (bounded by the number of features) reach the driver. Ridge scores made out of
fold are binned, and pool-adjacent-violators turns the bins into a calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.common import BYTE_CODE, blocks, cut, distinct_by_row, lower_bytes, prefix_hash, shingles, span_hash, text_buffer, words

FEATURES, RIDGE = 160, 0.3
#: Labelled rows that the model is fitted on at most: those with the least hashes of doc_id and label.
FIT_ROWS = 50_000
#: Score bins a unit, and the range that they cover.
BINS, LOWEST, HIGHEST = 256, -1.0, 2.0
PIECE_BYTES = 1 << 20
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(rb"#$%&*+/<=>@[\]^_`{|}~", np.uint8))
_MARKS = np.isin(np.arange(256), np.frombuffer(rb"!\"'(),-.:;?", np.uint8))

STATISTICS = (
    "log bytes", "log words", "bytes a word", "spread of word bytes", "upper case", "digits", "symbols", "marks", "exclamations", "outside ASCII", "white space",
    "words a line", "distinct words", "distinct word pairs", "words like the last", "words with a symbol", "words of capitals", "words without a letter", "distinct lines", "longest run of a word",
)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of all texts in a buffer (rows x statistics); an empty text's are 0."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    each = 1 / np.maximum(size, 1)
    after_c3 = np.concatenate([[False], data[:-1] == 0xC3])[: len(data)]
    upper = ((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E))
    lower = ((data >= 97) & (data <= 122)) | (after_c3 & (data >= 0xA0))
    symbol = _SYMBOLS[data]
    starts, ends, rows = words(data, offsets)
    count = np.bincount(rows, minlength=n).astype(float)
    per_word = 1 / np.maximum(count, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(rows, length, n) * per_word
    spread = np.sqrt(np.maximum(np.bincount(rows, length**2, n) * per_word - mean**2, 0))
    codes = span_hash(prefix_hash(BYTE_CODE[lower_bytes(data)]), starts, ends)
    kinds = np.bincount(distinct_by_row(codes, rows)[1], minlength=n)
    pairs, pair_rows, _ = shingles(codes, rows, n, 2)
    pair_kinds = np.bincount(distinct_by_row(pairs, pair_rows)[1], minlength=n)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    run = np.arange(len(codes)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(codes)))) + 1 if len(codes) else np.zeros(0)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, run)
    inside = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))
    letters = inside(upper | lower)
    newline = data == 10
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], np.flatnonzero(newline) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_rows, minlength=n).astype(float)
    line_kinds = np.bincount(distinct_by_row(span_hash(prefix_hash(BYTE_CODE[data]), line_starts, line_ends), line_rows)[1], minlength=n)
    part = lambda mask: _sums(mask, offsets) * each
    return np.stack(
        [
            np.log1p(size), np.log1p(count), np.minimum(mean, 50), np.minimum(spread, 50), part(upper), part(((data >= 48) & (data <= 57))), part(symbol), part(_MARKS[data]), part(data == 33), part(data >= 128),
            part((data == 32) | ((data >= 9) & (data <= 13))), np.log1p(count / np.maximum(lines, 1)), kinds * per_word, pair_kinds * per_word, np.bincount(rows, again, n) * per_word,
            np.bincount(rows, inside(symbol) > 0, n) * per_word, np.bincount(rows, (inside(upper) > 1) & (inside(lower) == 0), n) * per_word, np.bincount(rows, letters == 0, n) * per_word, line_kinds / np.maximum(lines, 1), np.log1p(longest),
        ],
        1,
    )


def with_statistics(docs: DataFrame, kept: str) -> DataFrame:
    """The columns ``kept`` (names and types) and statistics of each row of ``docs`` (text and those)."""
    names = [x.split()[0] for x in kept.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in blocks(offsets, PIECE_BYTES):
                found = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*[batch.column(x)[a:b] for x in names], pa.FixedSizeListArray.from_arrays(found.ravel(), found.shape[1]).cast(pa.list_(pa.float64()))], [*names, "statistics"])

    return docs.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(work, f"{kept}, statistics array<double>")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Model:
    """Scaling, random directions, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        draw = np.random.default_rng(11)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = draw.normal(size=(len(STATISTICS), FEATURES)) / np.sqrt(len(STATISTICS) / 2)
        self.phases = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.by_fold: dict[int, np.ndarray] = {}
        self.raw, self.chance = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of label 1."""
        return np.clip(np.interp(self.expand(x) @ self.weights, self.raw, self.chance), 0, 1)


def _solve(products: np.ndarray) -> np.ndarray:
    gram, right = products[:, :-1], products[:, -1]
    ridge = RIDGE * np.eye(len(gram))
    ridge[-1, -1] = 1e-6
    return np.linalg.solve(gram + ridge, right)


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the blocks that pool-adjacent-violators leaves; x ascends."""
    stack: list[list[float]] = []
    for at, count, good in zip(x, n, positive, strict=True):
        stack.append([count, good, at * count])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            last = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], last, strict=True)]
    return np.array([s[2] / s[0] for s in stack]), np.array([s[1] / s[0] for s in stack])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from ``docs`` (doc_id, text) and FIT_ROWS labels (doc_id, quality 0 or 1) of folds 0 and 2 at most;
    None without any. Null and other labels are left out; each row of labels counts. Only the texts of the drawn
    labels are read: they are few enough to be broadcast."""
    doc_id = F.col("doc_id").cast("long")
    marks = labels.where("quality in (0, 1)").select(doc_id.alias("doc_id"), F.col("quality").cast("double").alias("y"), fold(F.col("doc_id")).cast("int").alias("fold")).where("fold <> 1 and doc_id is not null")
    drawn = marks.orderBy(F.xxhash64("doc_id", "y"), "doc_id", "y").limit(FIT_ROWS)
    labelled = docs.select(doc_id.alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    known = cut(with_statistics(labelled, "y double, fold int"))
    size = len(STATISTICS)
    moments = known.agg(F.count("*"), *[f(F.col("statistics")[k]) for k in range(size) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    model = Model(np.array(moments[1::2]), np.array(moments[2::2]))
    width = FEATURES + 2
    sums_schema = "fold int, place int, part int, sums array<double>"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of this partition's outer products of (features, 1) with (features, 1, label)."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                z, y, part = model.expand(_matrix(batch.column("statistics"), size)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
                for k in np.unique(part).tolist():
                    total[k] = total.get(k, 0) + z[part == k].T @ np.hstack([z, y[:, None]])[part == k]
        for k, sums in total.items():
            salt = int(abs(float(sums[0, 0])) * 1e6) % 64
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width - 1, k, np.int32)), pa.array(np.arange(width - 1, dtype=np.int32)), pa.array(np.full(width - 1, salt, np.int32)), pa.array(list(sums))], ["fold", "place", "part", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        sums = _matrix(rows.column("sums").combine_chunks(), width).sum(0)
        return pa.table([rows.column("fold")[:1], rows.column("place")[:1], pa.array([0], pa.int32()), pa.array([sums])], names=["fold", "place", "part", "sums"])

    partial = known.mapInArrow(products, sums_schema).groupBy("fold", "place", "part").applyInArrow(add, sums_schema)
    halves: dict[int, np.ndarray] = {}
    for row in partial.groupBy("fold", "place").applyInArrow(add, sums_schema).collect():
        halves.setdefault(row["fold"], np.zeros((width - 1, width)))[row["place"]] = row["sums"]
    model.weights = _solve(sum(halves.values()))
    model.by_fold = {k: _solve(sum((v for j, v in halves.items() if j != k), np.zeros((width - 1, width)))) if len(halves) > 1 else model.weights for k in halves}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, part = model.expand(_matrix(batch.column("statistics"), size)), batch.column("fold").to_numpy()
                raw = np.zeros(batch.num_rows)
                for k, w in model.by_fold.items():
                    raw[part == k] = z[part == k] @ w
                yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(raw, LOWEST, HIGHEST) * BINS).astype(np.int32)), batch.column("y")], ["bin", "y"])

    bins = known.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()
    model.raw, model.chance = isotonic(np.array([r["bin"] / BINS for r in bins]), np.array([float(r["n"]) for r in bins]), np.array([r["good"] for r in bins]))
    return model


def _scores(texts: pa.Array, model: Model | None) -> np.ndarray:
    """Score of each text; 0.5 without a model."""
    out = np.full(len(texts), 0.5)
    if model is not None:
        data, offsets = text_buffer(texts)
        for a, b in blocks(offsets, PIECE_BYTES):
            out[a:b] = model.score(statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    return out


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and score, the chance of label 1 from 0 to 1.

    The model is fitted on labelled rows of folds 0 and 2. Whole texts are read, nothing but the
    text counts; null and empty texts have all statistics 0 and get a score too. Without usable labels
    all scores are 0.5. Repeated rows and ids are scored each; other columns are ignored. An empty table
    gives an empty result.
    """
    model = fit(docs, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), model))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) whose score is at least ``least``, with all their columns.

    Null and empty texts are scored like others, so they stay or go together; equal texts share their fate, and
    repeated rows all stay or all go. Ids count for nothing but the labels. Without usable labels all scores
    are 0.5. An empty table gives an empty result.
    """
    model = fit(docs, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), model) >= least))

    return docs.mapInArrow(work, docs.schema)
