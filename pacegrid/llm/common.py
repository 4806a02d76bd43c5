"""Helpers shared by the corpus operators: table access, lineage cuts and vectorised text hashing.

Text work inside tasks is done on UTF-8 byte buffers with numpy. Hashes are pairs of prefix
polynomials modulo the prime 2**31 - 1, at two points drawn at random: with prefix array ``H`` the
value of any span is ``(H[end] - H[start]) * B**-start``, so one pass over the bytes answers every
span. Two different spans of n codes have equal pairs with a chance of (n / 2**31)**2 at most,
whatever they hold; modulo a power of two, texts exist that collide at every point.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
#: The two points that polynomials are taken at.
POINTS = (1_482_937_611, 1_906_215_733)
_P, _SHIFT = np.uint64(PRIME), np.uint64(31)
_BACKS = tuple(pow(point, -1, PRIME) for point in POINTS)
#: Elements that are hashed at once, so that they stay in a core's cache.
BLOCK = 1 << 14
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared checkpoint folder and read it again.

    This cuts the lineage like a checkpoint; besides, the optimizer starts from a plain scan, while
    rows of a checkpoint keep all constraints of the plan that made them, which multiply round by round.
    ``spark.checkpoint.dir`` is honoured. A private folder is set only where a local session has none: on a
    cluster, where others could not read it, that is an error. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, once no later table is to be read from it."""
    context = df.sparkSession.sparkContext
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if path.rsplit("/", 1)[1].startswith("cut-"):
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan refers to any more: its cleaner acts only when the driver collects garbage,
    which a driver with little to do may not until long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets (n + 1); nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    offsets, data, base = [np.zeros(1, np.int64)], [], 0
    for part in parts:
        if not len(part):
            continue
        own = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        if part.buffers()[2] is not None:
            data.append(np.frombuffer(part.buffers()[2], np.uint8)[own[0] : own[-1]])
        offsets.append(own[1:] - own[0] + base)
        base = offsets[-1][-1]
    return np.concatenate(data) if data else np.zeros(0, np.uint8), np.concatenate(offsets)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**63; works in place."""
    for _ in range(2):
        high = x >> _SHIFT
        x &= _P
        x += high
    return np.minimum(x, x - _P, out=x)  # below PRIME the difference wraps round


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(16, (n - 1).bit_length()), np.uint64)
        done = 1
        while done < len(have):
            have[done : 2 * done] = _reduced(have[:done] * np.uint64(pow(base, done, PRIME)))
            done *= 2
        if n <= 1 << 23:  # a very long text's tables aren't kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Both prefix polynomials (2 x n + 1) of uint64 codes; element i covers codes[:i]."""
    out = np.zeros((2, len(codes) + 1), np.uint64)
    for k, point in enumerate(POINTS):
        weights = powers(point, len(codes))
        for a in range(0, len(codes), BLOCK):
            b = min(a + BLOCK, len(codes))
            own = codes[a:b] >> np.uint64(31 * k)
            own &= _P
            own *= weights[a:b]
            found = np.cumsum(_reduced(own), out=out[k, a + 1 : b + 1], dtype=np.uint64)
            found += out[k, a]
            _reduced(found)
    return out


def spliced(head: np.ndarray, n: int, tail: np.ndarray, m: int) -> np.ndarray:
    """Prefix polynomials of the first n codes of ``head`` and the first m of ``tail`` behind them, from those of both."""
    moved = [_reduced(head[k, n] + _reduced(tail[k, 1 : m + 1] * np.uint64(pow(point, n, PRIME)))) for k, point in enumerate(POINTS)]
    return np.concatenate([head[:, : n + 1], np.stack(moved)], 1)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of each span [start, end)."""
    out = np.zeros(len(start), np.uint64)
    backs = [powers(point, prefix.shape[1]) for point in _BACKS]
    for a in range(0, len(start), BLOCK):
        some, low, high = out[a : a + BLOCK], start[a : a + BLOCK], end[a : a + BLOCK]
        for own, back in zip(prefix, backs, strict=True):
            value = own[high]
            value += _P
            value -= own[low]
            value *= back[low]
            some <<= _SHIFT
            some |= _reduced(value)
        some[:] = mix(some)
    return out


def blocks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a longer row stands alone."""
    out, first = [], 0
    for row in range(1, len(offsets)):
        if row == len(offsets) - 1 or offsets[row + 1] - offsets[first] > most:
            out.append((first, row))
            first = row
    return out


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words: runs of bytes other than space and 0x09-0x0D, never across rows."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    inside = ~space
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | begins[: len(data)]))
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(codes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and first words of all ``width``-word shingles.

    A row with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(len(codes))
    full = at + width <= first[rows + 1] if len(codes) else np.zeros(0, bool)
    prefix = prefix_hash(codes)
    at = at[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    starts = np.concatenate([at, first[short]])
    ends = np.concatenate([at + width, first[short + 1]])
    hashes = span_hash(prefix, starts, ends) ^ mix((ends - starts).astype(np.uint64))
    return hashes, np.concatenate([rows[at], short]), starts


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, in that order."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]
