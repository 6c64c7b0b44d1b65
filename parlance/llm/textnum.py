"""Numpy views of Arrow text columns: slabs, words and rolling fingerprints.

A fingerprint joins two polynomials modulo the prime 2**31 - 1, each at a base of its own: a prefix sum of ``byte * base**i``
gives the fingerprint of every span of a slab as a difference times ``base**-start``, so that all spans come from one pass
over the bytes. It depends on the bytes of the span alone, never on where the span stands. Two given strings of n bytes
agree in one polynomial at n bases of 2**31 at most, however they are built, so in both with a chance of n**2 / 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


PRIME, HALF = U64((1 << 31) - 1), U64(31)
#: Values worked on at a time, so that they stay in the cache.
STRIDE = 1 << 15


def _fold(x: np.ndarray, high: np.ndarray) -> None:
    """Half of a reduction modulo the prime, in place: below 2**62 it leaves less than 2**32, below 2**33 at most 2**31 + 3."""
    np.right_shift(x, HALF, out=high)
    x &= PRIME
    x += high


class Polynomial:
    """Fingerprints of spans of equal length for one base modulo the prime.

    A power is the product of one for the place in its stride and one for the stride, so that tables stay small however long a text is.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(PRIME))
        self.up, self.down = self._powers(self.base, STRIDE), self._powers(self.inverse, STRIDE)
        self.far = np.ones(1, U64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, U64)
        while len(out) < n:
            out = np.concatenate((out, out * U64(pow(base, len(out), int(PRIME))) % PRIME))
        return out[:n]

    def _strides(self, n: int) -> np.ndarray:
        """Inverse powers of the first places of ``n`` strides."""
        if len(self.far) < n:
            self.far = self._powers(pow(self.inverse, STRIDE, int(PRIME)), 2 * n)
        return self.far

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums before each place, of values below 2**31; they are below 2**32, not always the least residue."""
        n = len(values)
        out, high = np.zeros(n + 1, U64), np.empty(STRIDE, U64)
        carry, power, step = U64(0), U64(1), U64(pow(self.base, STRIDE, int(PRIME)))
        for lo in range(0, n, STRIDE):
            x = values[lo : lo + STRIDE].astype(U64)
            h = high[: len(x)]
            x *= self.up[: len(x)]
            _fold(x, h)
            at = out[lo + 1 : lo + 1 + len(x)]
            np.cumsum(x, out=at)
            _fold(at, h)
            at *= power
            _fold(at, h)
            at += carry
            _fold(at, h)
            carry, power = at[-1], power * step % PRIME
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, out: np.ndarray, shift: int) -> None:
        """Adds the fingerprints, shifted to the left, to ``out``; ``start`` and ``end`` are places, or slices of them from 0 and from some place on."""
        n, high = len(out), np.empty(STRIDE, U64)
        far = self._strides(len(prefix) // STRIDE + 1)
        for lo in range(0, n, STRIDE):
            hi = min(n, lo + STRIDE)
            h = high[: hi - lo]
            if isinstance(start, slice):
                from_, to = slice(lo, hi), slice(end.start + lo, end.start + hi)
                down = self.down[: hi - lo] * far[lo // STRIDE]
            else:
                from_, to = start[lo:hi], end[lo:hi]
                down = self.down[from_ % STRIDE] * far[from_ // STRIDE]
            _fold(down, h)
            _fold(down, h)
            x = prefix[to] + U64(int(PRIME) << 2)
            x -= prefix[from_]
            _fold(x, h)
            x *= down
            _fold(x, h)
            _fold(x, h)
            np.subtract(x, PRIME, out=x, where=x >= PRIME)
            x <<= U64(shift)
            out[lo:hi] |= x


class Roller:
    """64-bit fingerprints of spans: two polynomials side by side. Spans of different lengths are told apart by their callers."""

    def __init__(self, one: int, two: int):
        self.parts = Polynomial(one), Polynomial(two)

    def prefix(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of bytes; of 64-bit values the high and the low half count, each in one polynomial."""
        if values.dtype == U64:
            return self.parts[0].prefix(values >> U64(34)), self.parts[1].prefix(values & U64((1 << 30) - 1))
        return self.parts[0].prefix(values), self.parts[1].prefix(values)

    def _spans(self, prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray | slice, end: np.ndarray | slice, n: int) -> np.ndarray:
        out = np.zeros(n, U64)
        for part, sums, shift in zip(self.parts, prefix, (32, 0), strict=True):
            part.spans(sums, start, end, out, shift)
        return out

    def spans(self, prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._spans(prefix, start, end, len(start))

    def grams(self, prefix: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
        """The fingerprint of the k values from each position on."""
        n = max(0, len(prefix[0]) - k)
        return self._spans(prefix, slice(0, n), slice(k, k + n), n)


#: Bases drawn at random once, so that no text was made to fit them.
BYTES, BYTES2 = Roller(1307674391, 586241737), Roller(1986090259, 943311703)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array without nulls (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null("") if column.null_count else column


def slabs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): whole texts, of ``limit`` bytes together or one longer text."""
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(at, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+`` of a slab."""
    inside = WORD_BYTE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets[1:], start, "right")


def word_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray, roller: Roller = BYTES) -> np.ndarray:
    """A 64-bit print of each word's bytes and length."""
    return mix(roller.spans(roller.prefix(data), start, end) + (end - start).astype(U64) * U64(0x165667B19E3779F9))


def code_points(data: np.ndarray) -> np.ndarray:
    """The code points of a slab of UTF-8."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def char_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the texts in code points."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return heads[offsets]
