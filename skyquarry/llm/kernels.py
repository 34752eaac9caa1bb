"""Array kernels over Arrow text columns: words, lines and their hashes, without a string per word.

A batch is worked off in chunks of whole texts of about CHUNK bytes together (or as many as the caller says),
so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LENGTH, _PLACE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a lane.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """Hashes of stretches of one chunk of bytes.

    A stretch is read in lanes of eight bytes; each lane is mixed with its place in the stretch, and the
    mixed lanes are summed. No arithmetic is left between the bytes that a text could be built to defeat, as
    Thue-Morse strings defeat polynomials modulo 2 ** 64.
    """

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = data
        self.lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.int64)
        count = (size + 7) >> 3
        ends = np.cumsum(count)
        if not len(ends) or not ends[-1]:
            return mix(size.astype(np.uint64) * _LENGTH)
        nth = np.arange(ends[-1]) - np.repeat(ends - count, count)
        left = np.repeat(size, count) - 8 * nth
        lane = self.lanes[np.repeat(start, count) + 8 * nth].astype(np.uint64, copy=False)
        lane = lane & _FIRST[np.minimum(left, 8)]
        salt = mix(np.arange(1, int(count.max()) + 1, dtype=np.uint64) * _PLACE)
        sums = np.zeros(len(lane) + 1, dtype=np.uint64)
        np.cumsum(mix(lane ^ salt[nth]), out=sums[1:])
        return mix(sums[ends] - sums[ends - count] + size.astype(np.uint64) * _LENGTH)


_BASE = np.uint64(0x9E6C63D0876A9A47)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Powers are made by so many at a time.
_STEP = 1 << 16


class _Kept(dict):
    """A cache that stays behind when its module travels."""

    def __reduce__(self):
        return _Kept, ()


_powers = _Kept()


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept between chunks."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = -(-n // _STEP) * _STEP
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n``-byte window, by prefix sums of a polynomial: only for short windows, and where
    another hash tells apart what clashes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _power(_INVERSE, len(sums))[: len(data) - n + 1])


@dataclass
class Chunk:
    """Texts ``first`` to ``last`` (exclusive) of a batch: their bytes on end, and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask holds."""
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start and end of each word, and for each text (and one more) the number of words before it."""
        inside = ~SPACE[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        return start, end, np.searchsorted(start, self.offsets)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The texts of a string column, nulls as empty ones, in chunks of about ``size`` bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
