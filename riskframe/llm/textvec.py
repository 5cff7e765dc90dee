"""Words, hashes and spans of many texts at once, on the UTF-8 bytes of an Arrow column.

Texts are worked on whole, in blocks of a quarter of a megabyte; a longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 4096), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit moves all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """Per byte value: 0 for separators, else the byte (A-Z in lower case if wanted) plus 1."""
    table = np.arange(1, 257, dtype=np.uint16)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words between blanks: everything but the space and tab to carriage return.
BLANK = bytes([0x20, *range(0x09, 0x0E)])
#: Words of letters and digits: everything but ASCII marks and control characters.
MARKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (and the last ends); null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive texts, ``limit`` bytes or one text at a time."""
    data, offsets = text_bytes(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    pa.default_memory_pool().release_unused()


@dataclass(frozen=True)
class Words:
    """Words of a block in order: byte spans, a 64-bit hash each, and per text the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's words of one value a word."""
        return sums_between(values, self.bounds)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; empty ranges give 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, dtype=kind, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def span_hashes(coded: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of consecutive spans, of the given lengths (1 at least), that fill ``coded``."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(coded)) - np.repeat(begin, lengths)
    total = np.add.reduceat(coded.astype(np.uint64) * powers(int(lengths.max()))[place], begin)
    return mix(total + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    coded = table[data]
    inside = coded > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = span_hashes(coded[inside], end - start) if hashed else np.zeros(0, np.uint64)
    return Words(start, end, hashes, np.searchsorted(start, offsets))
