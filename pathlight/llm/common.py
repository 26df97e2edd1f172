"""What the text operators share: tables, written intermediates and a vectorised word kernel.

The kernel works on the raw UTF-8 bytes of an Arrow string column, so a batch of
documents becomes words and 64-bit word hashes without a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.plans.lineage import cut, discard  # noqa: F401

#: Bytes of text that the kernel turns into words at once; bounds its scratch memory.
BLOCK = 1 << 20
#: Bytes of text that an operator handles at once (one document at least).
SLICE = 4 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words are runs of anything but space and \x09-\x0D.
SPACED = ~WHITE
#: Words are runs of 0-9, A-Z, a-z and every non-ASCII byte.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again. The step's shuffle files go with its end, the table by `discard`."""
    return cut(df)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving the memory that it has freed back to the system at its end: workers stay for later tasks, and what they hold counts for the executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it holds
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(column, by: int):
    """crc32 of the value as text, modulo by; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % by


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows so that each part holds about `most` bytes of text, or one row."""
    if not batch.num_rows:
        return
    ends = np.asarray(offsets_of(batch.column(column)), np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


def offsets_of(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * np.dtype(kind).itemsize)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and each row's offsets in them."""
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(array).astype(np.int64)
    data = array.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    byte = np.arange(256, dtype=np.uint64)
    byte[0x41:0x5B] += np.uint64(32)
    with np.errstate(over="ignore"):
        return mix((byte + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C55
_powers: list[np.ndarray] = []
_CODES = _byte_codes()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[:] = both
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: (first word of each row and the total, hashes, starts, ends).

    A-Z hash as a-z. Starts and ends are byte positions in data. A word ends with its row.
    """
    inside = kind[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    left, right = inner[inner < len(data)], inner[inner > 0] - 1
    opens[left] = inside[left]
    closes[right] = inside[right]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return np.searchsorted(starts, offsets), span_hashes(data, starts, ends), starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """A hash of each stretch of bytes; both ends ascend. Equal bytes hash alike wherever they stand."""
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = int(ends[to - 1])
        up, down = _power_tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(codes[data[low:high]] * up[: high - low], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return hashes


def rolling(first: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words: (first window of each row and the total, hashes)."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if not begin[-1]:
        return begin, np.empty(0, np.uint64)
    joined = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        joined = joined * np.uint64(0xD1342543DE82EF95) + hashes[j : len(hashes) - k + 1 + j]
    joined = mix(joined + np.uint64(k))
    keep = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    return begin, joined[keep]


def hash_phrase(text: str, kind: np.ndarray = SPACED) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), kind)[1]
