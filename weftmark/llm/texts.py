"""Words of a batch of texts as arrays: spans and 64-bit hashes, without a loop over words.

Texts are handled as UTF-8 bytes.  A word is a run of bytes that are not ASCII white
space, which no multi-byte character contains, so words never break a character.  Word
hashes are polynomials over random byte codes modulo 2**64, taken from running sums
in one pass; window hashes are Rabin-Karp polynomials over word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text whose arrays are in memory at a time; one document at least.
CHUNK_BYTES = 2 << 20
#: Bytes of the longest word that is hashed by a polynomial.
LONG_WORD = 64
#: Rows of text in an Arrow batch at most.
BATCH_ROWS = 1000

_rng = np.random.Generator(np.random.PCG64(20240613))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the byte base and of its inverse modulo 2**64."""
    size = 1 << max(21, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size + 1, _BASE), np.full(size + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


@dataclass
class Words:
    """Words of consecutive documents: byte spans, hashes, and where each document's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # per document the index of its first word, and the number of words at the end

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the window of ``width`` words that starts at each word."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        total = np.zeros(n - width + 1, dtype=np.uint64)
        for j in range(width):
            total = total * _WORD_BASE + self.hashes[j : n - width + 1 + j]
        hashes = np.zeros(n, dtype=np.uint64)
        hashes[: n - width + 1] = _mix(total)
        last = np.repeat(self.first[1:], np.diff(self.first))
        return hashes, np.arange(n) + width <= last


def words_of(texts: pa.Array, lower: bool) -> Words:
    """Words of an Arrow string array; a null has none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(raw, dtype=np.uint8)[low:high] if raw is not None else np.empty(0, np.uint8)
    bounds = offsets - low
    if texts.null_count:  # nulls have no bytes of their own in Spark's batches
        lengths = np.diff(bounds)
        if lengths[~texts.is_valid().to_numpy(zero_copy_only=False)].any():
            return words_of(pa.array(texts.fill_null(b""), pa.large_binary()), lower)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        empty = np.empty(0, dtype=np.int64)
        return Words(data, empty, empty, np.empty(0, np.uint64), np.zeros(len(texts) + 1, dtype=np.int64))
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _base_powers(n)
    running = np.empty(n + 1, dtype=np.uint64)
    running[0] = 0
    np.cumsum(_CODE[data] * up[:n], out=running[1:])
    hashes = _mix((running[end] - running[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return Words(data, start, end, hashes, np.searchsorted(start, bounds, side="left"))


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, so that batches of texts stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str, budget: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``budget`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Bits:
    """A fixed-size set of hashes: no false negative, some false positives, never larger."""

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, dtype=np.uint8)
        self.shift = np.uint64(64 - (len(data) * 8).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
