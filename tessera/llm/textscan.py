"""Vectorised word scanning of Arrow text columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; as those six separators are
ASCII, scanning UTF-8 bytes is the same as scanning code points. Texts are cut into *slabs* of whole
rows of about half a megabyte, so the working set stays in cache and memory stays bounded whatever
the batch; one very long text is a slab of its own.

Hashes are 64-bit polynomial hashes with a random value per byte, taken from prefix sums modulo
2**64 and finished by an avalanche mix. They are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C13
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche finish of 64-bit values (the splitmix64 finalizer)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = -(-n // (1 << 16)) << 16
        inverse = pow(base, -1, 2**64)
        up, down = np.full(size, base, U), np.full(size, inverse, U)
        up[0] = down[0] = 1
        got = _powers[base] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return got[0][:n], got[1][:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``; element 0 is 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def ranged(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Position-free hash of each ``[start, end)`` from ``prefix`` sums, mixed with its length."""
    down = powers(base, len(sums))[1]
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Slab:
    """Rows ``lo..hi`` of a column: bytes, word bounds, and each row's first word (``first[r]..first[r+1]``)."""

    __slots__ = ("lo", "hi", "raw", "offsets", "starts", "ends", "first")

    def __init__(self, lo: int, hi: int, raw: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.raw, self.offsets = lo, hi, raw, offsets
        n = len(raw)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~_SEPARATOR[raw]
        edge = word[1:] != word[:-1]
        cut = np.zeros(n + 1, bool)
        cut[offsets[1:-1]] = True
        inside = cut & word[1:] & word[:-1]  # a row ends and the next begins in mid-run
        self.starts = np.flatnonzero((edge & word[1:]) | inside)
        self.ends = np.flatnonzero((edge & word[:-1]) | inside)
        self.first = np.searchsorted(self.starts, offsets, "left")

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def word_rows(self) -> np.ndarray:
        """The row of each word, from 0 in this slab."""
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def word_hashes(self, lower: bool = False, base: int = _P) -> np.ndarray:
        """A 64-bit hash per word; ``lower`` folds A-Z first; another odd ``base`` gives another hash."""
        values = (_BYTE[_LOWER] if lower else _BYTE)[self.raw]
        return ranged(prefix(values, base), self.starts, self.ends, base)

    def text(self, row: int) -> str:
        """One row."""
        return self.raw[self.offsets[row] : self.offsets[row + 1]].tobytes().decode()

    def words(self, row: int) -> list[bytes]:
        """The words of one row."""
        raw, a, b = self.raw, self.first[row], self.first[row + 1]
        data = raw.tobytes() if self.rows == 1 else raw[self.offsets[row] : self.offsets[row + 1]].tobytes()
        base = 0 if self.rows == 1 else self.offsets[row]
        return [data[s - base : e - base] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    got = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return got, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slabs(column: pa.Array, size: int = 1 << 19) -> Iterator[Slab]:
    """The column in slabs of whole rows of about ``size`` bytes."""
    offsets, data = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        yield Slab(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def shingle_sets(slab: Slab, k: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles.

    A row of 1 to k-1 words has its whole sequence as the one shingle; a row without words has none.
    """
    w = slab.word_hashes(lower)
    base = U(0x2545F4914F6CDD1D)
    h = w
    if len(w) >= k:
        n = len(w) - k + 1
        h = w[:n].copy()
        for j in range(1, k):
            h *= base
            h += w[j : n + j]
        h = mix64(h)
    first = slab.first.tolist()
    for r in range(slab.rows):
        a, b = first[r], first[r + 1]
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            x = U(b - a)
            with np.errstate(over="ignore"):
                for v in w[a:b]:
                    x = x * base + v
            yield mix64(np.array([x], U) ^ U(0xA0761D6478BD642F))
        else:
            yield np.zeros(0, U)
