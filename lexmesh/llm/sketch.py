"""Saturating counters over hashed keys, built per partition and merged by segment.

Each key touches ``depth`` counters that saturate at two: a counter is never below the number of
contributions that touch it, so "all counters of the key are at two" holds for every key seen twice
(and for some others). That is a count-min estimate cut at two, or, seen as bits, a Bloom filter of keys
seen once beside one of keys seen twice.

A task sends the counters it has touched as compressed gaps, split by segment; tasks of the second stage
add up whole segments in an array of fixed size, whatever the number of partitions; the driver receives one
bit per counter. ``bits_for`` bounds that: beyond ``MAX_BITS`` counters the filter lets more keys pass, and
what passes is always confirmed exactly afterwards. ``fine`` counts in more counters than the driver receives bits: keys seen
once then fill no bits, however many there are; a bit says that one of its counters is at two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmesh.llm.words import mix
from lexmesh.session import shuffles_cleaned

MAX_BITS = 28
_SEGMENTS = 16
_LARGEST_SEGMENT = 25  # log2 of the counters that a task adds up at once
_FLUSH = 1 << 20


def bits_for(keys: int, per_key: int = 8) -> int:
    """log2 of the number of counters for so many keys, at most ``MAX_BITS`` (32 MB as bits)."""
    return int(min(MAX_BITS, max(16, np.ceil(np.log2(max(1, keys) * per_key)))))


def fine_bits(keys: int) -> int:
    """log2 of the number of counters in which few of so many different keys meet."""
    return int(min(40, max(16, np.ceil(np.log2(max(1, keys) * 16)))))


def _positions(keys: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    spread = mix(keys)
    second = mix(spread ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return [(spread + second * np.uint64(i)) >> np.uint64(64 - bits) for i in range(depth)]


def _pack(values: np.ndarray) -> bytes:
    gaps = np.diff(values, prepend=0).astype("<u4")
    return zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)  # high bytes, mostly zero, lie together


def _unpack(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(payload), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _partials(contributions: Iterator[np.ndarray], bits: int, depth: int, segments: int = _SEGMENTS, held_keys: int = _FLUSH) -> Iterator[pa.RecordBatch]:
    """Each array of 64-bit keys is one unit's set of keys; equal keys of different units count twice."""
    shift = np.uint64(bits) - np.uint64(int(np.log2(segments)))
    size = 1 << int(shift)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        # a counter counts a key once per contribution, so distinct keys of one unit may share counters
        for position in _positions(every, bits, depth):
            position.sort()
            first = np.ones(len(position), bool)
            first[1:] = position[1:] != position[:-1]
            again = np.zeros(len(position), bool)
            again[1:] = ~first[1:]
            rows = []
            for level, chosen in ((1, position[first]), (2, np.unique(position[again]))):
                cuts = np.searchsorted(chosen, np.arange(segments + 1, dtype=np.uint64) << shift)
                for s in range(segments):
                    if cuts[s] < cuts[s + 1]:
                        rows.append((s, level, _pack((chosen[cuts[s]:cuts[s + 1]] & np.uint64(size - 1)).astype(np.int64))))
            if rows:
                yield pa.RecordBatch.from_pydict({"segment": pa.array([r[0] for r in rows], pa.int32()), "level": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})

    held, count = [], 0
    for keys in contributions:
        held.append(keys)
        count += len(keys)
        if count >= held_keys:
            yield from flush(held)
            held, count = [], 0
    if count:
        yield from flush(held)


def _merge(size: int, apart: int = 1):
    """Whole segments of ``size`` counters, as one bit for each ``apart`` of them. If that is more than one, rows come sorted by segment."""
    def bits_of(segment: int, held: np.ndarray) -> pa.RecordBatch:
        twice = (held >= 2).reshape(-1, apart).any(axis=1)
        return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "payload": pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, level, payload in zip(batch["segment"].to_pylist(), batch["level"].to_pylist(), batch["payload"]):
                if apart > 1 and segment not in counters and counters:
                    yield bits_of(*counters.popitem())
                if segment not in counters:
                    counters[segment] = np.zeros(size, np.uint8)
                held = counters[segment]
                at = _unpack(payload.as_py())
                held[at] = np.minimum(held[at] + 1, 2) if level == 1 else 2
        for segment, held in counters.items():
            yield bits_of(segment, held)

    return run


class Repeated:
    """One bit per counter: at least two contributions. Holds 2^bits bits and nothing else."""

    def __init__(self, spark, bits: int, depth: int, packed: np.ndarray):
        self.bits, self.depth = bits, depth
        self._value = spark.sparkContext.broadcast(packed)

    def reader(self) -> Callable[[np.ndarray], np.ndarray]:
        """To be called inside a task: which keys may have been contributed at least twice."""
        value, bits, depth = self._value, self.bits, self.depth

        def test(keys: np.ndarray) -> np.ndarray:
            packed = value.value
            found = np.ones(len(keys), bool)
            for position in _positions(keys, bits, depth):
                found &= (packed[position >> np.uint64(3)] >> (np.uint64(7) - (position & np.uint64(7))).astype(np.uint8)) & 1 == 1
            return found

        return test


def repeated_keys(df: DataFrame, contributions: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, depth: int, fine: int = 0) -> Repeated:
    """Sketch of the keys that ``contributions`` takes from the partitions of ``df``.

    With ``fine`` over ``bits`` and a depth of 1 there are 2^fine counters.
    """
    counted = max(bits, fine) if depth == 1 else bits
    segments = max(_SEGMENTS, 1 << max(0, counted - _LARGEST_SEGMENT))
    held_keys = _FLUSH if counted == bits else 2 * _FLUSH

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _partials(contributions(batches), counted, depth, segments, held_keys)

    dealt = df.mapInArrow(partials, "segment int, level int, payload binary").repartition(segments, "segment")
    if counted > bits:
        dealt = dealt.sortWithinPartitions("segment")
    size = (1 << bits) // segments // 8
    packed = np.zeros(segments * size, np.uint8)
    with shuffles_cleaned(df.sparkSession):
        rows = dealt.mapInArrow(_merge((1 << counted) // segments, 1 << (counted - bits)), "segment int, payload binary").collect()
    for row in rows:
        packed[row["segment"] * size:(row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["payload"]), np.uint8)
    return Repeated(df.sparkSession, bits, depth, packed)
