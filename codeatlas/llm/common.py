"""Shared helpers: tables, learning folds, Arrow text chunks and word hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes of a text (every
separator is one ASCII byte, so bytes and code points agree).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # text bytes that a task turns into numpy arrays at a time
BATCH_BYTES = 4 << 20  # bytes of an Arrow batch, unless one row is larger

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED_CODE = _BYTE_CODE.copy()
_FOLDED_CODE[65:91] = _BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(df: DataFrame) -> None:
    """Let Arrow batches of the session end at BATCH_BYTES as well as at their
    number of rows, so that a task's memory does not grow with wide rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def released(run):
    """A task function that hands freed memory back to the system at its end:
    workers live on, and what they keep adds to the executor's heap."""
    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)
    return task


def text_chunks(column: pa.ChunkedArray | pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into bytes) for runs of rows of about
    ``size`` bytes; one longer text is a run of its own. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        step = np.full(n, base, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values so that any bits of the result may be used."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def words(data: np.ndarray, offsets: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a run of texts, and each text's offsets
    into them. A word's hash is a polynomial of its bytes, taken for all words
    at once from one running sum; ``fold_case`` lower-cases A-Z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    begin[inner] = word[inner]
    end = word.copy()
    end[:-1] &= ~word[1:]
    before = inner[inner > 0] - 1
    end[before] = word[before]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    code = (_FOLDED_CODE if fold_case else _BYTE_CODE)[data]
    code *= _power("up", len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code, out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * _power("down", len(data))[starts])
    return hashes, np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words (empty with fewer words)."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:k].copy()
    for i in range(1, n):
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + hashes[i:i + k])
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``n``-word shingles; with fewer words
    the whole sequence is one shingle; no words: empty."""
    if not len(hashes):
        return hashes
    return np.unique(ngrams(hashes, min(n, len(hashes))))


def batches(columns: dict[str, pa.DataType], rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of Python values as Arrow batches of bounded length."""
    schema = pa.schema(list(columns.items()))
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), columns.values())], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), columns.values())], schema=schema)
