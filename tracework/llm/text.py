"""Vectorised text helpers used inside tasks: pieces of a batch, word spans, substring hashes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import SparkSession

#: Words are runs of anything but these bytes: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"
PIECE = 1 << 20
ONE = np.uint64(1)


def lean(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for whole texts: Python workers hold a few batches at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * PIECE))
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Prefix:
    """Hashes of any range of units from one running sum: the sum of value * base ** position, shifted back to the range's start."""

    _bases = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, family: int = 0):
        self.up, self.down = self._powers(len(values) + 1, family)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    @classmethod
    def _powers(cls, n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._tables.get(family)
        if have is None or len(have[0]) < n:
            base = cls._bases[family]
            both = []
            for x in (base, pow(base, -1, 1 << 64)):
                v = np.full(max(n, PIECE + 4096), x, np.uint64)
                v[0] = ONE
                both.append(np.cumprod(v, dtype=np.uint64))
            have = (both[0], both[1])
            if n <= PIECE + 4096:
                cls._tables[family] = have
        return have

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * np.uint64(0x9E3779B97F4A7C15))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))


BYTES = (seeded(256, 11), seeded(256, 23))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE, overlap: int = 0) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """Cut rows (given by offsets) into pieces of about ``size``: rows, offset of the first byte inside its row, start, inner bounds.

    Short rows are gathered; a row longer than ``size`` becomes several pieces that overlap by ``overlap``.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        length = int(offsets[i + 1] - offsets[i])
        if length > size + overlap:
            at = 0
            while True:
                to = min(at + size + overlap, length)
                yield np.array([i]), at, int(offsets[i]) + at, np.array([0, to - at])
                if to == length:
                    break
                at += size
            i += 1
        else:
            j = max(int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1, i + 1)
            yield np.arange(i, j), 0, int(offsets[i]), (offsets[i : j + 1] - offsets[i])
            i = j


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a buffer; no word crosses a row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACES[raw]
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = space[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    before[edges] = True
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[edges[1:] - 1] = True
    word = ~space
    start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def canonical(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """Each text's words joined by one space, as one buffer with the offsets of its rows; null reads as empty."""
    raw, offsets = buffer_of(column)
    data = raw.tobytes()
    texts = [b" ".join(data[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words of a buffer, and the word bounds of its rows.

    Hashing goes piece by piece, cut between words, so scratch memory stays near ``PIECE`` however long a text is.
    """
    start, end, row = word_spans(raw, offsets)
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + PIECE, "right")), i + 1)
        low = start[i]
        hashes[i:j] = Prefix(BYTES[0][raw[low : end[j - 1]]]).ranges(start[i:j] - low, end[i:j] - low)
        i = j
    bounds = np.searchsorted(row, np.arange(len(offsets)), "left")
    return start, end, hashes, bounds


def pack(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Texts as zstd frames, a third smaller in a shuffle than its own block compression leaves them, and their sizes in bytes."""
    press = zstandard.ZstdCompressor(level=1).compress
    texts = column.cast(pa.large_binary()).to_pylist()
    return pa.array([None if t is None else press(t) for t in texts], pa.binary()), pa.array([0 if t is None else len(t) for t in texts], pa.int64())


def unpack(column: pa.Array, sizes: pa.Array) -> pa.Array:
    """The texts of ``pack``."""
    open_ = zstandard.ZstdDecompressor().decompress
    texts = [None if z is None else open_(z, max_output_size=n) if n else b"" for z, n in zip(column.to_pylist(), sizes.to_pylist(), strict=True)]
    return pa.array(texts, pa.large_binary()).cast(pa.large_string())


def slices(batch: pa.RecordBatch, column: str, size: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """Split a batch by rows so that each part holds about ``size`` bytes of text (one row at least).

    ``column`` holds the texts, or their sizes in bytes.
    """
    sizes = batch.column(column)
    lengths = (sizes if pa.types.is_integer(sizes.type) else pc.fill_null(pc.binary_length(sizes), 0)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    i = 0
    while i < len(ends):
        done = ends[i - 1] if i else 0
        j = max(int(np.searchsorted(ends, done + size, "right")), i + 1)
        yield batch.slice(i, j - i)
        i = j
