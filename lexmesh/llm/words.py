"""Vectorised word, shingle and window hashes of UTF-8 text columns inside a task.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``; those bytes never occur inside a multi-byte
character, so working on bytes equals working on code points. Temporary arrays are bounded by
``SLICE`` bytes of text, however long a document is; per document only 8 bytes a word are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    if count:
        powers[0] = 1
    return np.multiply.accumulate(powers)


class Polynomial:
    """Hashes of all sub-sequences from one prefix sum, modulo 2^64."""

    def __init__(self, seed: int):
        odd = int(mix(np.array([seed * 2 + 1], np.uint64))[0]) | 1
        self.base, self.inverse = np.uint64(odd), np.uint64(pow(odd, -1, 1 << 64))
        self._up, self._down = _powers(self.base, 1), _powers(self.inverse, 1)

    def _grow(self, count: int) -> None:
        if len(self._up) < count:
            self._up, self._down = _powers(self.base, count), _powers(self.inverse, count)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._up[:len(values)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self._down[starts])


_BYTE_POLYNOMIAL = Polynomial(11)
_PLAIN = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _PLAIN.copy()
_FOLDED[ord("A"):ord("Z") + 1] = _PLAIN[ord("a"):ord("z") + 1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _slice_words(data: np.ndarray, doc_starts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one slice; a word never crosses a document start."""
    blank = _BLANK[data]
    border = np.zeros(len(data) + 1, bool)
    border[doc_starts] = True
    border[-1] = True
    starts = np.flatnonzero(~blank & (border[:-1] | np.concatenate(([True], blank))[:len(data)]))
    ends = np.flatnonzero(~blank & (border[1:] | np.concatenate((blank, [True]))[1:])) + 1
    prefix = _BYTE_POLYNOMIAL.prefix((_FOLDED if fold else _PLAIN)[data])
    return starts, ends, _BYTE_POLYNOMIAL.between(prefix, starts, ends)


def _cut(data: np.ndarray, low: int, high: int) -> int:
    """Where to end a slice of a long document: behind white space, if there is any."""
    end = min(low + SLICE, high)
    while end < high and not _BLANK[data[end - 1]]:
        step = _BLANK[data[end:end + SLICE]]
        found = np.flatnonzero(step)
        end = end + int(found[0]) + 1 if len(found) else min(end + SLICE, high)
    return end


def documents(column: pa.Array | pa.ChunkedArray, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word bounds of each row, word hashes, byte starts, byte ends) for runs of rows.

    ``bounds`` has one entry more than the run has rows. Byte positions count from the start of the row's text.
    """
    data, offsets = utf8(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        low, high = int(offsets[row]), int(offsets[row + 1])
        if high - low > SLICE:
            parts = []
            at = low
            while at < high:
                end = _cut(data, at, high)
                starts, ends, h = _slice_words(data[at:end], np.zeros(1, np.int64), fold)
                parts.append((starts + (at - low), ends + (at - low), h))
                at = end
            starts, ends, h = (np.concatenate(x) for x in zip(*parts))
            yield row, np.array([0, len(h)]), h, starts, ends
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, low + SLICE, side="right")) - 1)
        last = min(last, rows)
        local = offsets[row:last + 1] - low
        starts, ends, h = _slice_words(data[low:int(offsets[last])], local[:-1], fold)
        bounds = np.searchsorted(starts, local)
        begins = np.repeat(local[:-1], np.diff(bounds))
        yield row, bounds, h, starts - begins, ends - begins
        row = last


def grams(h: np.ndarray, bounds: np.ndarray, size: int, polynomial: Polynomial) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each start, and whether they lie in one document."""
    count = len(h) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(count)
    hashes = polynomial.between(polynomial.prefix(h), at, at + size)
    whole = np.ones(count, bool)
    for end in bounds[1:-1]:  # starts too close to the end of a document
        whole[max(0, end - size + 1):end] = False
    return hashes, whole


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
