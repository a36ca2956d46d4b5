"""Columns of text as byte arrays: class tables, words and rolling hashes with numpy.

Everything here works on one bounded chunk of whole rows at a time, inside a
task. Null text counts as empty text throughout.
"""

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
LONG_SPAN = 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SYMBOLS = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)


def _class_table(low_high_pairs):
    table = np.zeros(256, dtype=bool)
    for low, high in low_high_pairs:
        table[low:high + 1] = True
    return table


# Bytes of words: digits, ASCII letters after lower-casing, and all of UTF-8 beyond ASCII.
ALNUM = _class_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
# Bytes of words cut at ASCII white space.
NONBLANK = ~_class_table([(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def chunks(batches, column="text", limit=CHUNK_BYTES):
    """Slices of Arrow batches with about `limit` bytes of text; a longer row stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        first, n = 0, batch.num_rows
        while first < n:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
        del batch, sizes
        release()


def release():
    """Give freed memory back to the system: workers are reused, and share it with their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column):
    """(all bytes, row bounds) of a string column; row i is bytes[bounds[i]:bounds[i + 1]]."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_spans(data, bounds, table):
    """(starts, ends, words before each row's end) of the maximal runs of a byte class."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = ~inside
    stops[1:] &= inside[:-1]
    stops[0] = False
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    inner = edge[inside[edge] & inside[edge - 1]]
    begins[inner] = True
    stops[inner] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, bounds)


class Hasher:
    """64-bit hashes of any spans of a byte array from one running sum.

    The sum of symbol * multiplier^i over a prefix gives every span by one
    subtraction; powers of the inverse take the place out again. Modulo 2^64 such
    sums are equal for long balanced, self-similar spans and their mirror images,
    whatever the multiplier, so spans above LONG_SPAN symbols are hashed one by
    one from their own bytes when `data` is given.
    """

    def __init__(self):
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grow(self, n):
        if len(self._powers) < n:
            size = (n | 0xFFFFF) + 1
            for name, base in (("_powers", _MULTIPLIER), ("_inverses", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, data):
        return self.prefix_of(_SYMBOLS[data])

    def prefix_of(self, symbols):
        """Running sums over 64-bit symbols."""
        self._grow(len(symbols) + 1)
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self._powers[:len(symbols)], out=sums[1:])
        return sums

    def spans(self, sums, starts, ends, data=None):
        values = (sums[ends] - sums[starts]) * self._inverses[starts]
        hashes = mix(values + (ends - starts).astype(np.uint64))
        if data is not None:
            for i in np.flatnonzero(ends - starts > LONG_SPAN):
                digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
                hashes[i] = int.from_bytes(digest, "little")
        return hashes

    def grams(self, sums, k):
        """Hashes of all k-byte grams, by start."""
        n = len(sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((sums[k:] - sums[:n]) * self._inverses[:n])


def mix(values):
    """Spread every input bit over the 64 output bits."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def pack(values):
    """Sorted or small whole numbers as compressed bytes."""
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def unpack(blob, dtype, n):
    size = int(n) * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), dtype) if size else np.zeros(0, dtype)
