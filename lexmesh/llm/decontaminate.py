"""Benchmark decontamination with spaced seeds.

A mask looks at some of the words of a span and ignores the others, so two passages that differ only in ignored words hash
alike. The masks are chosen so that any ``WINDOW`` aligned words with at most ``ERRORS`` substitutions agree on all looked-at words
of one mask at one place: nothing within that tolerance is missed. Hashes of the test set go into a bit filter of bounded
size; what passes it in the training texts is joined to the test hashes on the whole hash, and each hit is
verified word by word along its alignment, with enough context to see every window that holds the hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.sketch import bits_for, repeated_keys
from lexmesh.llm.storage import without, written
from lexmesh.llm.words import documents, mix, signed

WINDOW = 15
ERRORS = 2
# Looked-at positions of the masks. Together they find every WINDOW aligned words with up to ERRORS substitutions.
MASKS = ((0, 1, 2, 3, 5, 6, 7, 8), (0, 1, 2, 3, 7, 9, 10, 11), (0, 1, 3, 5, 6, 7, 8, 9))
LEAST = 8


def lossless(masks: tuple[tuple[int, ...], ...], window: int, errors: int) -> bool:
    """Whether each way to put ``errors`` substitutions into ``window`` words leaves one mask whole somewhere."""
    places = [frozenset(p + shift for p in m) for m in masks for shift in range(window - m[-1])]
    return all(any(place.isdisjoint(bad) for place in places) for bad in combinations(range(window), errors))


def _seeds(h: np.ndarray, bounds: np.ndarray, mask: tuple[int, ...], number: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of one mask over all places that lie in one text."""
    span = mask[-1] + 1
    count = len(h) - span + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(number + 1))
    for p in mask:
        total = (total + h[p:p + count]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    whole = np.ones(count, bool)
    for end in bounds[1:-1]:
        whole[max(0, end - span + 1):end] = False
    starts = np.flatnonzero(whole)
    return starts, mix(total[starts])


def _masks(short: list[int]) -> list[tuple[int, tuple[int, ...], int]]:
    """(number, mask, window): the spaced masks, and a solid one for each length of a shorter test item."""
    return [(i, m, WINDOW) for i, m in enumerate(MASKS)] + [(100 + n, tuple(range(n)), n) for n in short]


def _item_rows(short: list[int]):
    """Seeds of test items with their context. An item below ``WINDOW`` words has the solid mask of its length alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, bounds, h, _, _ in documents(batch.column(1), fold=True):
                sizes = np.diff(bounds)
                yield from _contexts(h, bounds, _masks(short), lambda d, window: (sizes[d] >= WINDOW) if window == WINDOW else (sizes[d] == window),
                                     None, lambda d: pa.array([ids[row + i] for i in d.tolist()], pa.int64()), "item")
    return run


def _contexts(h, bounds, masks, wanted, test, ids, name) -> Iterator[pa.RecordBatch]:
    for number, mask, window in masks:
        starts, keys = _seeds(h, bounds, mask, number)
        keep = np.ones(len(starts), bool) if test is None else test(keys) if len(keys) else np.zeros(0, bool)
        starts, keys = starts[keep], keys[keep]
        d = np.searchsorted(bounds, starts, side="right") - 1
        if wanted is not None and len(d):
            ok = wanted(d, window)
            starts, keys, d = starts[ok], keys[ok], d[ok]
        if not len(starts):
            continue
        span = mask[-1] + 1
        low, high = np.maximum(bounds[d], starts + span - window), np.minimum(bounds[d + 1], starts + window)
        words = [signed(h[a:b]) for a, b in zip(low.tolist(), high.tolist())]
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(signed(keys)), "mask": pa.array(np.full(len(starts), number, np.int32)), f"{name}_id": ids(d),
            f"{name}_at": pa.array((starts - bounds[d]).astype(np.int32)), f"{name}_before": pa.array((starts - low).astype(np.int32)),
            f"{name}_words": pa.array(words, pa.list_(pa.int64()))})


def _item_keys(short: list[int]):
    rows = _item_rows(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in rows(batches):
            keys = np.asarray(batch["key"]).view(np.uint64)
            yield np.concatenate((keys, keys))  # twice: the filter then answers "is one of these"
    return run


def _hits(short: list[int], test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for row, bounds, h, _, _ in documents(batch.column(2), fold=True):
                for found in _contexts(h, bounds, _masks(short), None, test, lambda d: pa.array(d + row), "doc"):
                    at = found["doc_id"]
                    yield pa.RecordBatch.from_arrays([found["key"], found["mask"], ids.take(at), rows.take(at), *(found[c] for c in ("doc_at", "doc_before", "doc_words"))],
                                                     ["key", "mask", "doc_id", "row", "doc_at", "doc_before", "doc_words"])
    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts, in the document, of the aligned windows around each hit that stay within the tolerance."""
    for batch in batches:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        starts = []
        for mask, at, x_before, x, y_before, y in zip(*(column[n].to_pylist() for n in ("mask", "doc_at", "doc_before")), column["doc_words"], column["item_before"].to_pylist(), column["item_words"]):
            a, b = x.values.to_numpy(), y.values.to_numpy()
            before = min(x_before, y_before)
            a, b = a[x_before - before:], b[y_before - before:]
            count = min(len(a), len(b))
            window, errors = (WINDOW, ERRORS) if mask < 100 else (mask - 100, 0)
            wrong = np.concatenate(([0], np.cumsum(a[:count] != b[:count])))
            good = np.flatnonzero(wrong[window:] - wrong[:-window] <= errors) if count >= window else ()
            starts.append([int(at - before + g) for g in good])
        sizes = [WINDOW if m < 100 else m - 100 for m in column["mask"].to_pylist()]
        yield pa.RecordBatch.from_arrays([column["doc_id"], column["row"], column["item_id"], pa.array(starts, pa.list_(pa.int32())), pa.array(sizes, pa.int32())],
                                         ["doc_id", "row", "item_id", "starts", "size"])


def contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """Per (document, test item) that overlap: doc_id, row, item_id, first_word, n_words.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased. A document and an item overlap where ``WINDOW``
    consecutive words of both agree but for at most ``ERRORS`` substituted words; an item of ``LEAST`` to ``WINDOW`` - 1 words must
    occur whole. Items with fewer words cannot be told from ordinary language and overlap with nothing, nor do null or empty
    texts. ``n_words`` counts the document's words inside such windows, ``first_word`` is the first (from 0). Rows that repeat an
    id and differ in text are told apart by ``row``, a hash of the text; null ids are kept as they are. Extra columns are not read.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    items = tests.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    lengths = items.select(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("n")).filter((F.col("n") >= LEAST) & (F.col("n") < WINDOW)).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # WINDOW - LEAST lengths at most
    seeds = written(items.mapInArrow(_item_rows(short), "key long, mask int, item_id long, item_at int, item_before int, item_words array<long>"), "test-seeds")
    filtered = repeated_keys(items, _item_keys(short), bits_for(seeds.count(), per_key=24), depth=4)
    hits = rows.mapInArrow(_hits(short, filtered.reader()), "key long, mask int, doc_id long, row long, doc_at int, doc_before int, doc_words array<long>")
    met = hits.join(seeds.withColumnRenamed("mask", "_mask"), "key").filter("mask = _mask").select(
        "doc_id", "row", "item_id", "mask", "doc_at", "doc_before", "doc_words", "item_before", "item_words")
    found = met.mapInArrow(_verified, "doc_id long, row long, item_id long, starts array<int>, size int").filter(F.size("starts") > 0)
    spans = found.select("doc_id", "row", "item_id", "size", F.explode("starts").alias("start")).distinct()
    words = spans.select("doc_id", "row", "item_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("word")).distinct()
    return words.groupBy("doc_id", "row", "item_id").agg(F.min("word").cast("long").alias("first_word"), F.count(F.lit(1)).alias("n_words"))


def without_contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap with no test item."""
    return without(docs, contaminated(docs, tests), "contaminated")
