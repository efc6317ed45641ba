"""Vectorised text kernels over Arrow string buffers (numpy only, no per-word Python).

Words are ``[^\\x20\\x09-\\x0D]+``; A-Z can be lower-cased first. A slice is the UTF-8 of
several texts laid end to end with the offsets between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 5
_COMBINE = _RNG.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd step and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _powers[:] = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers.append(np.multiply.accumulate(t))
    return _powers[0], _powers[1]


@dataclass
class Slice:
    """Texts ``first .. first + len`` of an Arrow batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    lower: bool = True

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def parts(self, rows: int) -> Iterator[Slice]:
        """The slice in pieces of at most ``rows`` texts, whose first counts within this one."""
        for i in range(0, len(self), rows):
            o = self.offsets[i : i + rows + 1]
            yield Slice(i, self.data[o[0] : o[-1]], o - o[0], self.lower)

    @cached_property
    def bytes_(self) -> np.ndarray:
        return _LOWER[self.data] if self.lower else self.data

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        solid = ~_SPACE[self.data]
        n = len(solid)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        before[edge] = False
        after[edge - 1] = False
        starts = np.flatnonzero(solid & ~before)
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    @property
    def word_starts(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def word_ends(self) -> np.ndarray:
        return self._bounds[1]

    @property
    def word_ranges(self) -> np.ndarray:
        """Text i has the words ``ranges[i] .. ranges[i + 1]``."""
        return self._bounds[2]

    @cached_property
    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        starts, ends, _ = self._bounds
        n = len(self.data)
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes_] * up[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    @cached_property
    def shingle_hashes(self) -> np.ndarray:
        """Hash of the five words that begin at each word; meaningless where the text ends sooner."""
        w = self.word_hashes
        k = SHINGLE_WORDS
        if len(w) < k:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            out += w[j : j + len(out)] * _COMBINE[j]
        return mix(out)

    def shingles(self, i: int) -> np.ndarray:
        """The shingles of text i in order; with fewer than five words the whole sequence is one."""
        a, b = self.word_ranges[i], self.word_ranges[i + 1]
        if b - a >= SHINGLE_WORDS:
            return self.shingle_hashes[a : b - SHINGLE_WORDS + 1]
        if b == a:
            return np.zeros(0, np.uint64)
        w = self.word_hashes[a:b]
        return mix(np.array([(w * _COMBINE[: b - a]).sum() + np.uint64(b - a)], np.uint64))


def slices(column: pa.Array, lower: bool = True, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``most`` bytes; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]
