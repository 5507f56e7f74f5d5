"""Whole texts of an Arrow batch as flat byte arrays, cut into words and hashed with numpy.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. Those bytes never occur inside a UTF-8 sequence, so bytes do.
Hashes are 64 bits wide; two different words, lines or windows of one text that hash alike
(chance about 2**-64 a pair) would be taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, n, dtype=np.uint64)


_BYTE = _random(256, 1)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n * 3 // 2, 1 << 16)
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Slice:
    """Some rows of a batch: ``rows`` (a slice), ``data`` (their bytes), ``offsets``."""

    def __init__(self, rows: slice, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets
        self.n = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, data: np.ndarray | None = None) -> "Spans":
        """The words of all rows, none reaching over the end of a row."""
        data = self.data if data is None else data
        size = len(data)
        sep = SPACE[data]
        first, last = np.ones(size, dtype=bool), np.ones(size, dtype=bool)
        if size:
            first[1:] = sep[:-1]
            last[:-1] = sep[1:]
            edges = self.offsets[1:-1]
            first[edges[edges < size]] = True
            last[edges[edges > 0] - 1] = True
        return self._spans(np.flatnonzero(~sep & first), np.flatnonzero(~sep & last) + 1)

    def lines(self) -> "Spans":
        r"""The pieces of all rows between \n, empty ones too; an empty row has one."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        per_row = np.searchsorted(breaks, self.offsets)
        bounds = per_row + np.arange(self.n + 1)
        return Spans(starts, ends, bounds)

    def _spans(self, starts: np.ndarray, ends: np.ndarray) -> "Spans":
        return Spans(starts, ends, np.searchsorted(starts, self.offsets))


class Spans:
    """Pieces of a slice: byte ``starts`` and ``ends``; row i owns ``bounds[i]:bounds[i+1]``."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.bounds = starts, ends, bounds

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The row of each piece."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each piece's bytes."""
        return span_hashes(_BYTE[data], self.starts, self.ends)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash the pieces of a sequence of 64-bit values by differences of one running sum."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring hashes, by its first one."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(_random(size, 7 + size) | _U(1)):
        out += hashes[i : i + n] * factor
    return mix(out)


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 30) -> Iterator[Slice]:
    """Cut a string column (null: empty) into slices of about ``max_bytes``, ``max_rows`` at most.

    A row is never cut, so one longer text makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + max_bytes, side="right")) - 1
        high = min(max(high, low + 1), low + max_rows, len(column))
        yield Slice(
            slice(low, high),
            data[offsets[low] : offsets[high]],
            (offsets[low : high + 1] - offsets[low]).astype(np.int64),
        )
        low = high
