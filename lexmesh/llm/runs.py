"""Words of UTF-8 text columns as arrays, for any class of word bytes.

The classes used here never split a multi-byte character: bytes from 0x80 on are always word bytes.
Temporary arrays are bounded by ``SLICE`` bytes of text (or by one word, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from lexmesh.llm.words import utf8

SLICE = 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


class Slice(NamedTuple):
    """Rows ``row`` to ``row + len(starts) - 1``; the first may continue a text, the last may go on in the next slice."""
    row: int
    continues: bool
    goes_on: bool
    data: np.ndarray
    starts: np.ndarray  # of each row in ``data``


def slices(column: pa.Array | pa.ChunkedArray, word: np.ndarray, whole: bool = False) -> Iterator[Slice]:
    """Whole texts together up to ``SLICE`` bytes; longer texts alone, cut (unless ``whole``) behind bytes that belong to no word."""
    data, offsets = utf8(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        low, high = int(offsets[row]), int(offsets[row + 1])
        if high - low <= SLICE or whole:
            last = max(row + 1, min(rows, int(np.searchsorted(offsets, low + SLICE, side="right")) - 1))
            yield Slice(row, False, False, data[low:int(offsets[last])], offsets[row:last] - low)
            row = last
            continue
        at = low
        while at < high:
            end = min(at + SLICE, high)
            while end < high and word[data[end - 1]]:
                gaps = np.flatnonzero(~word[data[end:end + SLICE]])
                end = end + int(gaps[0]) + 1 if len(gaps) else min(end + SLICE, high)
            yield Slice(row, at > low, end < high, data[at:end], np.zeros(1, np.int64))
            at = end
        row += 1


def words(data: np.ndarray, starts: np.ndarray, word: np.ndarray, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, row within the slice) of every word; a word ends where its row ends, and before each byte in ``split``."""
    inside = word[data]
    border = np.zeros(len(data) + 1, bool)
    if split is not None:
        border[:-1] = split
    border[starts] = True
    border[-1] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (border[:-1] | ~before))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (border[1:] | ~after)) + 1
    return first, end, np.searchsorted(starts, first, side="right") - 1


def distinct(data: np.ndarray, word: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """A number for each word, and the different words by number."""
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(end - first, out=offsets[1:])
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[word[data]])])
    coded = every.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def squeezed(columns: np.ndarray) -> bytes:
    """A matrix of unsigned 32-bit numbers, compressed; bytes of the same weight lie together."""
    raw = np.ascontiguousarray(columns, "<u4")
    return raw.shape[-1].to_bytes(8, "little") + pa.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unsqueezed(payload: bytes, rows: int = 1) -> np.ndarray:
    width = int.from_bytes(payload[:8], "little")
    raw = pa.decompress(payload[8:], 4 * rows * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(rows, width)
