"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, ``<turn>role<says>text</turn>`` for each turn, and encoded once;
the tokenizer's offsets are then intersected with the turns' text spans by binary search. The three
marks are tokens of their own, so no token reaches over the edge of a text. Inside roles and texts a
backslash is doubled and the ``<`` of a mark becomes ``\\l``, which reading back undoes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
TRAINED_ROLE = "assistant"
_CONTROL = re.compile(r"\\|<(?=(?:turn|says|/turn)>)")
_ESCAPED = re.compile(r"\\([\\l])")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(SAYS) + r"(.*?)" + re.escape(CLOSE), re.S)

FORMATTED = "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
_FORMATTED_NAMES = [x.split()[0] for x in FORMATTED.split(", ")]


def escape(text: str) -> str:
    """Text without any mark; unescape() gives it back."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else "\\l", text)


def unescape(text: str) -> str:
    """Inverse of escape()."""
    return _ESCAPED.sub(lambda m: "<" if m[1] == "l" else "\\", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and the sorted spans (start, end) of the texts to be trained on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SAYS}", escape(text)
        parts += [head, body, CLOSE]
        if role == TRAINED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens [start, end), sorted, share a character with one of the sorted, disjoint spans."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    nearest = np.searchsorted(spans[:, 1], starts, side="right")
    inside = nearest < len(spans)
    return inside & (spans[np.minimum(nearest, len(spans) - 1), 0] < ends)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the loss mask, unescaped; each character once, however many tokens share it."""
    starts, ends = starts[mask], ends[mask]
    if not len(starts):
        return ""
    done = np.maximum.accumulate(ends)
    before = np.concatenate([[-1], done[:-1]])
    first = np.flatnonzero(starts > before)  # a gap in the mask starts a run
    return "".join(unescape(formatted[a:b]) for a, b in zip(starts[first].tolist(), done[np.append(first[1:], len(done)) - 1].tolist(), strict=True))


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([OPEN, SAYS, CLOSE])
    return tokenizer


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """Conversations of ``turns`` (conv_id, turn, role, text): conv_id, formatted, token_ids,
    token_starts, token_ends (code points of ``formatted``) and loss_mask (one flag a token).

    Turns stand by turn, then role and text; nulls come first, and a null role or text is empty.
    Repeated rows are turns of their own. A null conv_id is a conversation like others; other columns
    are ignored. An empty table gives no rows. ``tokenizer_path`` names a byte-level tokenizer file that
    every executor has.
    """
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])

    def finish(found: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
        rendered = [render(said) for _, said in found]
        encoded = _tokenizer(tokenizer_path).encode_batch([formatted for formatted, _ in rendered], add_special_tokens=False)
        counts = np.array([len(x) for x in encoded], np.int64)
        edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        spans = [np.array(x.offsets, np.int32).reshape(-1, 2) for x in encoded]
        masks = [token_mask(own[:, 0], own[:, 1], trained) for own, (_, trained) in zip(spans, rendered, strict=True)]
        both = np.concatenate([*spans, np.zeros((0, 2), np.int32)])
        flat = [np.array([i for x in encoded for i in x.ids], np.int32), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), np.concatenate([*masks, np.zeros(0, bool)])]
        heads = [pa.array([conv_id for conv_id, _ in found], pa.int64()), pa.array([formatted for formatted, _ in rendered], pa.string())]
        return pa.RecordBatch.from_arrays([*heads, *[pa.ListArray.from_arrays(edges, pa.array(x)) for x in flat]], _FORMATTED_NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; a conversation may go on in the next batch."""
        current: tuple[int | None, list[tuple[str, str]]] | None = None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if current is None or current[0] != conv_id:
                    done += [current] if current else []
                    current = (conv_id, [])
                current[1].append((role, text))
            for k in range(0, len(done), 256):
                yield finish(done[k : k + 256])
        if current:
            yield finish([current])

    dealt = rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    return dealt.mapInArrow(work, FORMATTED)
