"""Vectorised text primitives on the Arrow buffers of a string column.

A batch's texts are one UTF-8 byte array and row offsets. Everything here works on
that pair, so that a task's cost is a few numpy passes per byte and no Python object
per word. Null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes at a time (a longer text is taken whole).
SLICE_BYTES = 512 << 10

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column."""
    return _buffers(_whole(column).cast(pa.large_string()).fill_null(""))


def text_bytes_of_binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """text_bytes() of a binary column without nulls."""
    return _buffers(_whole(column).cast(pa.large_binary()))


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of True bytes; runs never cross rows."""
    if not len(inside):
        none = np.empty(0, np.int64)
        return none, none, none
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers that a worker keeps: enough for a slice. Those for a longer text are made and let go.
KEPT_POWERS = 1 << 20


def _made_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_kept_powers = lru_cache(maxsize=1)(lambda: _made_powers(KEPT_POWERS))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``size`` of them."""
    return _kept_powers() if size <= KEPT_POWERS else _made_powers(int(size))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (values[k] + 1) * BASE**k for i <= k < j."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    terms = values.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(values)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal contents hash equally wherever they stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def gathered(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... counts[i] of them, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block prefix and suffix minima."""
    n = len(values)
    if width == 1 or n < width:
        return values[: max(0, n - width + 1)].copy()
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z have become a-z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20
