"""Substring dedup over windows of words, behind a count-min sketch.

Equal windows choose the same anchor: the smallest hash among the grams of eight words inside the window, the
rightmost of equals. A run of windows with one anchor is a block. A first pass adds all anchors to per-partition
count-min sketches that are merged; an anchor's estimate is never below the number of times any of its windows
occurs, so windows whose anchor is estimated at one cannot repeat. The second pass groups, exactly and by 128-bit
digests, only blocks of anchors estimated as repeated. Where an anchor has several different blocks (the
ends of a copied passage), a sketch of their windows leaves those estimated as repeated for a third pass, which groups
single windows. Only texts that lose something are moved, once, to be rewritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.sketch import bits_for, repeated_keys
from lexmesh.llm.storage import written
from lexmesh.llm.words import Polynomial, documents, grams, signed

_ANCHOR_WORDS = 8
_ANCHOR, _FIRST, _SECOND = Polynomial(21), Polynomial(22), Polynomial(23)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _anchors(h: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of the anchor of each, and the hashes of all grams."""
    k = min(_ANCHOR_WORDS, window)
    inner, _ = grams(h, bounds, k, _ANCHOR)
    count = len(h) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), inner
    best, at = inner[:count].copy(), np.arange(count)
    for step in range(1, window - k + 1):  # a dozen passes over the array; the rightmost of equals wins
        later = inner[step:step + count]
        smaller = later <= best
        best = np.where(smaller, later, best)
        at[smaller] = np.flatnonzero(smaller) + step
    whole = np.ones(count, bool)
    for end in bounds[1:-1]:
        whole[max(0, end - window + 1):end] = False
    starts = np.flatnonzero(whole)
    return starts, at[starts], inner


def _blocks(starts: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor position, document) of each run of windows with one anchor."""
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    return starts[first], np.diff(np.append(first, len(starts))), at[first], np.searchsorted(bounds, starts[first], side="right") - 1


def _anchor_keys(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, bounds, h, _, _ in documents(batch.column(0)):
                starts, at, inner = _anchors(h, bounds, window)
                _, _, places, _ = _blocks(starts, at, bounds)
                if len(places):
                    yield inner[places]
    return run


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _suspect_blocks(window: int, test: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for row, bounds, h, _, _ in documents(batch.column(2)):
                starts, at, inner = _anchors(h, bounds, window)
                first, count, places, doc = _blocks(starts, at, bounds)
                keys = inner[places]
                chosen = np.flatnonzero(test(keys)) if len(keys) else np.zeros(0, np.int64)
                if not len(chosen):
                    continue
                first, count, places, doc, keys = first[chosen], count[chosen], places[chosen], doc[chosen], keys[chosen]
                end = first + count + window - 1
                shape = (places - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)
                b1 = _FIRST.between(_FIRST.prefix(h), first, end) ^ shape
                b2 = _SECOND.between(_SECOND.prefix(h), first, end) + shape
                take = pa.array(doc + row)
                yield _table({"anchor": pa.array(signed(keys)), "b1": pa.array(signed(b1)), "b2": pa.array(signed(b2)), "doc_id": ids.take(take),
                              "row": rows.take(take), "start": pa.array((first - bounds[doc]).astype(np.int32)), "count": pa.array(count.astype(np.int32))})
    return run


def _window_keys(window: int, test: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, bounds, h, _, _ in documents(batch.column(0)):
                starts, at, inner = _anchors(h, bounds, window)
                if len(starts) and len(starts := starts[test(inner[at])]):
                    yield _FIRST.between(_FIRST.prefix(h), starts, starts + window)
    return run


def _single_windows(window: int, test: Callable[[np.ndarray], np.ndarray], repeated: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for row, bounds, h, _, _ in documents(batch.column(2)):
                starts, at, inner = _anchors(h, bounds, window)
                if not len(starts):
                    continue
                starts = starts[test(inner[at])]
                w1 = _FIRST.between(_FIRST.prefix(h), starts, starts + window)
                chosen = repeated(w1)
                starts, w1 = starts[chosen], w1[chosen]
                if not len(starts):
                    continue
                doc = np.searchsorted(bounds, starts, side="right") - 1
                take = pa.array(doc + row)
                yield _table({"w1": pa.array(signed(w1)),
                              "w2": pa.array(signed(_SECOND.between(_SECOND.prefix(h), starts, starts + window))),
                              "doc_id": ids.take(take), "row": rows.take(take), "start": pa.array((starts - bounds[doc]).astype(np.int32))})
    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        keys = np.asarray(batch.column(0)).view(np.uint64)
        yield np.concatenate((keys, keys))  # twice each: the filter then answers "is one of these"


def _chosen(test: Callable[[np.ndarray], np.ndarray], wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(test(np.asarray(batch.column(1)).view(np.uint64)) == wanted))
    return run


def _repeats_inside(h: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows that also start earlier in the same document."""
    at = np.arange(len(h) - window + 1)
    if len(at) < 2:
        return at[:0]
    w1 = _FIRST.between(_FIRST.prefix(h), at, at + window)
    order = np.argsort(w1, kind="stable")
    same = w1[order[1:]] == w1[order[:-1]]
    if not same.any():
        return at[:0]
    w2 = _SECOND.between(_SECOND.prefix(h), at, at + window)
    order = np.lexsort((at, w2, w1))
    same = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
    return order[1:][same]


def _rewrite(window: int, keep_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cuts = batch.column(0).to_pylist(), batch.column(2)
            texts = batch.column(1).cast(pa.large_binary())
            out: list[list] = [[] for _ in names]
            for row, bounds, h, _, _ in documents(batch.column(1)):
                for i in range(len(bounds) - 1):
                    low, high = int(bounds[i]), int(bounds[i + 1])
                    words = high - low
                    split = (texts[row + i].as_py() or b"").split()  # splits bytes at the same six characters
                    change = np.zeros(words + 1, np.int32)
                    for pair in cuts[row + i].as_py() or ():
                        change[pair["start"]] += 1
                        change[pair["start"] + pair["count"] + window - 1] -= 1
                    inside = _repeats_inside(h[low:high], window)
                    np.add.at(change, inside, 1)
                    np.add.at(change, inside + window, -1)
                    kept = np.cumsum(change[:-1]) == 0
                    joined = b" ".join(split if kept.all() else compress(split, kept.tolist()))
                    values = [ids[row + i], words, words - int(kept.sum()), hashlib.sha256(joined).hexdigest()]
                    if keep_text:
                        values.append(joined.decode("utf-8", "replace"))
                    for column, value in zip(out, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.string()] * 2)], names)
    return run


def remove_repeated_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20, keep_text: bool = True,
                            expected_words: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by one space.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a row with a smaller id, or
    earlier in the same row. Windows are judged on the input. Null and empty texts have no words. Rows without an
    id are larger than all others; among rows that share an id none is earlier than another. Extra columns are not read.
    ``expected_words`` sizes the sketch (estimated from the bytes of text by default); the result does not depend on it.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    if expected_words is None:
        expected_words = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 5)
    bits = bits_for(expected_words // 5, per_key=6)
    anchors = repeated_keys(rows.select("text"), _anchor_keys(window), bits, depth=2)
    blocks = written(rows.mapInArrow(_suspect_blocks(window, anchors.reader()), "anchor long, b1 long, b2 long, doc_id long, row long, start int, count int"), "suspect-blocks")

    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    span = [F.min(order).alias("first"), F.max(order).alias("last")]
    classes = written(blocks.groupBy("anchor", "b1", "b2").agg(*span), "block-classes")
    several = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "mixed-anchors")
    mixed = repeated_keys(several, _several, bits_for(several.count(), per_key=12), depth=4)
    lengths = blocks.join(several, "anchor").agg(F.sum("count")).first()[0] or 0
    singles = repeated_keys(rows.select("text"), _window_keys(window, mixed.reader()), bits_for(lengths, per_key=6), depth=2)
    windows = written(rows.mapInArrow(_single_windows(window, mixed.reader(), singles.reader()), "w1 long, w2 long, doc_id long, row long, start int"), "suspect-windows")

    place = ["doc_id", "row", "start", "count"]
    later_blocks = blocks.join(classes.filter("first < last"), ["anchor", "b1", "b2"]).filter(order > F.col("first")).select(place)
    repeated = written(windows.groupBy("w1", "w2").agg(*span).filter("first < last"), "repeated-windows")
    later_windows = windows.join(repeated, ["w1", "w2"]).filter(order > F.col("first")).withColumn("count", F.lit(1)).select(place)
    cuts = later_blocks.unionByName(later_windows).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("start", "count")).alias("cuts"))
    cuts = written(cuts, "cuts")

    # texts without a cut are rewritten where they are read; only the others move
    moved = repeated_keys(cuts.select("_row"), _several, bits_for(cuts.count(), per_key=16), depth=4)
    same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    there = rows.mapInArrow(_chosen(moved.reader(), False), rows.schema).withColumn("cuts", F.lit(None).cast(cuts.schema["cuts"].dataType))
    placed = rows.mapInArrow(_chosen(moved.reader(), True), rows.schema).join(cuts.hint("shuffle_hash"), same, "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    rewritten = [df.select("doc_id", "text", "cuts").mapInArrow(_rewrite(window, keep_text), schema) for df in (there, placed)]
    return rewritten[0].unionByName(rewritten[1])
