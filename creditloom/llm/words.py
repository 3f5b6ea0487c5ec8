"""Words of Arrow text columns as flat numpy arrays.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed
and carriage return. Work inside a task goes over slices of bounded size, so the memory
of a worker follows the slice (or one longer text), not the Arrow batch.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Multipliers of the hashes; any odd numbers with well mixed bits serve.
BYTE_STEP = np.uint64(0x9E3779B97F4A7C15)
WORD_STEP = np.uint64(0xD6E8FEB86659FD93)
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (one to one)."""
    x = x ^ (x >> np.uint64(33))
    x *= MIX_A
    x ^= x >> np.uint64(33)
    x *= MIX_B
    x ^= x >> np.uint64(33)
    return x


_codes = mix(np.arange(1, 257, dtype=np.uint64) * BYTE_STEP)


def _power_table(step: int, n: int) -> np.ndarray:
    """step ** 0 .. step ** (n - 1) modulo 2 ** 64; kept between calls up to a slice."""
    table = _powers.get(step)
    if table is None or len(table) < n:
        table = np.full(max(n, SLICE_BYTES), np.uint64(step), dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) <= 4 * SLICE_BYTES:
            _powers[step] = table
    return table[:n]


@dataclass
class Words:
    """Words of some texts: byte spans in ``data`` and ``bounds[i]:bounds[i + 1]`` per text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    text_bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        inverse = pow(int(BYTE_STEP), -1, 1 << 64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.multiply(_codes[self.data], _power_table(int(BYTE_STEP), n), out=sums[1:])
        np.add.accumulate(sums, out=sums)
        raw = sums[self.ends] - sums[self.starts]
        return mix(raw * _power_table(inverse, n)[self.starts])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a text column with about ``limit`` bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    sizes = np.cumsum(np.asarray(pc.binary_length(column)))
    start = 0
    while start < len(column):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield start, column.slice(start, end - start)
        start = end


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a large_string array without nulls; ``lower`` maps A-Z to a-z."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if lower:
        raw = _lower[raw]
    gap = _space[raw]
    # A text border parts words as a space does.
    border = np.zeros(len(raw) + 1, dtype=bool)
    border[bounds] = True
    begin, end = ~gap, ~gap
    if len(raw):
        begin[1:] &= gap[:-1] | border[1:-1]
        end[:-1] &= gap[1:] | border[1:-1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, bounds), bounds)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position; positions too near the end are absent."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    step = int(WORD_STEP)
    # Sums over 1, 2, 4, ... words; k is put together from its binary digits.
    total, done, part, width = None, 0, words, 1
    while True:
        if k & width:
            factor = np.uint64(pow(step, done, 1 << 64))
            piece = part[done : done + n] * factor
            total = piece if total is None else total + piece
            done += width
        if done == k:
            return mix(total)
        part = part[:-width] + part[width:] * np.uint64(pow(step, width, 1 << 64))
        width *= 2


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    part, span = values, 1
    while span * 2 <= width:
        part = pick(part[:-span], part[span:])
        span *= 2
    return pick(part[:n], part[width - span : width - span + n])


def starts_within(bounds: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether ``width`` words from each of ``n`` word positions stay in one text."""
    fits = np.zeros(n, dtype=bool)
    if n:
        room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
        fits = room >= width
    return fits
