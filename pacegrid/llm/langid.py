"""Language identification by hierarchical discrimination.

Texts become relative frequencies of hashed byte n-grams. Languages are grouped into families by the
likeness of their mean frequencies; a prediction names the family first and then, inside it, the
language. Both choices are votes of one-versus-one linear support vector machines, each of which is
fitted in a task of its own on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.common import blocks, lower_bytes, text_buffer

ORDERS, BUCKETS = (1, 2, 3, 4), 2048
WIDTH = len(ORDERS) * BUCKETS
#: Labelled rows of each language that the classifiers are fitted on at most, and code points of the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
ROUNDS, PENALTY = 40, 1e-4
UNKNOWN = "und"
PIECE_BYTES = 1 << 20
#: Rows of features that are held at a time: 8 MiB of them.
BLOCK_ROWS = 256
_LETTER = re.compile(r"[^\W\d_]")


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters; ASCII other than letters becomes space."""
    data = lower_bytes(data)
    second = np.concatenate([[False], data[:-1] == 0xC3]) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data = np.where(second, data + 32, data).astype(np.uint8)
    return np.where((data < 128) & ((data < 97) | (data > 122)), 32, data).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram frequencies (rows x WIDTH, each order of unit length) of the texts in a buffer."""
    data = _folded(data)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    packed = data.astype(np.uint32)
    for place, order in enumerate(ORDERS):
        if order > 1:
            packed = packed[:-1] | (data[order - 1 :].astype(np.uint32) << np.uint32(8 * (order - 1)))
        bucket = (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
        for row, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if end - start >= order:
                counts = np.sqrt(np.bincount(bucket[start : end - order + 1], minlength=BUCKETS))
                out[row, place * BUCKETS : (place + 1) * BUCKETS] = counts / np.sqrt((counts**2).sum())
    return out


def fit_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge loss, dual coordinate descent); y is +-1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    share = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) / len(y) * 2 / (PENALTY * len(y))
    diagonal, norm = 0.5 / np.maximum(share, 1e-9), (x**2).sum(1)
    alpha, w, order = np.zeros(len(y)), np.zeros(x.shape[1]), np.random.default_rng(7)
    for _ in range(ROUNDS):
        for k in order.permutation(len(y)):
            gradient = y[k] * (x[k] @ w) - 1 + diagonal[k] * alpha[k]
            new = max(0.0, alpha[k] - gradient / (norm[k] + diagonal[k]))
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * x[k]
                alpha[k] = new
    return w


def families_of(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages merged by the cosine of their centred means until about sqrt(count) families are left."""
    groups = [[x] for x in sorted(means)]
    centre = np.mean(list(means.values()), 0)
    unit = {k: (v - centre) / max(np.linalg.norm(v - centre), 1e-12) for k, v in means.items()}
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: np.mean([unit[x] @ unit[y] for x in groups[p[0]] for y in groups[p[1]]]))
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


class Model:
    """Families and the one-versus-one machines between and inside them."""

    def __init__(self, families: list[list[str]], machines: dict[tuple[str, str], np.ndarray]) -> None:
        self.families = families
        self.pairs = sorted(machines)
        self.weights = np.stack([machines[p] for p in self.pairs], 1).astype(np.float32) if machines else np.zeros((WIDTH + 1, 0), np.float32)

    def _vote(self, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among ``names`` and its confidence in (0, 1]."""
        votes = np.zeros((len(margins), len(names)))
        for k, (a, b) in enumerate(self.pairs):
            if a in names and b in names:
                chance = 1 / (1 + np.exp(-np.clip(2.5 * margins[:, k], -30, 30)))
                votes[:, names.index(a)] += chance
                votes[:, names.index(b)] += 1 - chance
        best = votes.argmax(1)
        return best, votes[np.arange(len(votes)), best] / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(votes))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence of each row of features."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        family, sure = self._vote([f"family {k}" for k in range(len(self.families))], margins)
        names, score = np.empty(len(x), object), np.zeros(len(x))
        for k, members in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            best, inner = self._vote(members, margins[rows])
            names[rows], score[rows] = np.array(members, object)[best], inner * sure[rows]
        return names, score


def fit(docs: DataFrame) -> Model | None:
    """Model from rows with lang and a text of 1 to SAMPLE_CHARS code points; None without any. Each language
    gives the SAMPLE_ROWS rows with the least hashes of their ids; nothing else of the table is used."""
    labelled = docs.where(f"lang is not null and length(text) between 1 and {SAMPLE_CHARS}").select("lang", "text", F.xxhash64("doc_id").alias("order"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    reach = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * SAMPLE_ROWS / n)))])
    near = labelled.where(F.pmod("order", F.lit(1_000_003)) < reach[F.col("lang")] * 1_000_003)
    drawn = near.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("order", "text"))), 1, SAMPLE_ROWS).alias("drawn"))
    rows = drawn.select("lang", F.explode("drawn.text").alias("text")).collect()
    x = np.concatenate([features(*text_buffer(pa.array([r["text"]]))) for r in rows])
    langs = np.array([r["lang"] for r in rows], object)
    families = families_of({k: x[langs == k].mean(0) for k in sizes})
    groups = {f"family {k}": members for k, members in enumerate(families)} | {k: [k] for k in sizes}
    tasks = [*combinations([f"family {k}" for k in range(len(families))], 2), *[p for members in families for p in combinations(members, 2)]]
    if not tasks:
        return Model(families, {})
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((x, langs, groups))  # at most SAMPLE_ROWS rows of WIDTH floats for each language

    def fit_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, langs, groups = shared.value
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                side = np.isin(langs, groups[a]).astype(int) - np.isin(langs, groups[b]).astype(int)
                w = fit_svm(x[side != 0], side[side != 0])
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), pa.array([w.tolist()])], ["a", "b", "weights"])

    pairs = docs.sparkSession.createDataFrame(tasks, "a string, b string").repartition(len(tasks))
    fitted = pairs.mapInArrow(fit_pair, "a string, b string, weights array<double>").collect()
    return Model(families, {(r["a"], r["b"]): np.array(r["weights"]) for r in fitted})


def predict(docs: DataFrame, model: Model | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score.

    lang_pred is a learned language, or ``und`` with score 0 for a null text, one without letters, or
    without a model. score is the product of the family's and the language's share of votes. Only the
    text counts; whole texts are read. Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            known = np.array([bool(t and _LETTER.search(t)) for t in batch.column("text").to_pylist()])
            pieces = [(a, min(a + block_rows, last)) for first, last in blocks(offsets, PIECE_BYTES) for a in range(first, last, block_rows)]
            for a, b in pieces:
                names, scores = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
                if model is not None:
                    names, scores = model.predict(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    names[~known[a:b]], scores[~known[a:b]] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, lang_pred string, score double")
