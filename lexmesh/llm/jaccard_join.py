"""Jaccard self-join on word shingles, split by set size into a light and a heavy side.

Shingles have one global order from rare to frequent: first those that a sketch over all sets shows to be in one set alone, then
others by hash, last those that many texts hold (a bounded table, counted over all texts, gives their ranks). Two sets that reach the threshold must share

* for small sets: at least two shingles among their first few, so every pair of those is a key (fixed-size subsets);
* for large sets: at least one shingle among their first quarter, so each of those is a key (inverted lists).

The size that divides them is where enumerating subsets costs as much as scanning lists, from the list lengths of
a hash sample of shingles. A shingle of one set alone is never a key, so most sets that are like no other send nothing. Equal sets are one class
from the start, and of lists that hold the same classes one is kept. Inside a list candidates are first tested against a few centres; what that leaves in one component needs
no further test, and of the other pairs of the list all are tested that the distances to the centres allow. Links are decided on
whole sets, of which only the shingles that another set may hold have to meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.components import connected
from lexmesh.llm.sketch import bits_for, fine_bits, repeated_keys
from lexmesh.llm.storage import discard, without, written
from lexmesh.llm.words import Polynomial, documents, grams, mix, signed

_SHINGLE = Polynomial(31)
_FREQUENT = 1 << 15
_FLUSH = 1 << 21
_SAMPLE = np.uint64(1023)
_LARGEST_SMALL = 64
_TEST_COST = 4.0
_CENTRES = 3


def _ceil(a, b: int):
    return -(-a // b)


class Threshold:
    """Jaccard of at least ``top`` / ``bottom``, as overlaps."""

    def __init__(self, top: int = 3, bottom: int = 4):
        self.top, self.bottom = top, bottom

    def least(self, n):
        """Fewest shared shingles of a set of n with any partner."""
        return _ceil(self.top * n, self.bottom)

    def pair(self, a: Column, b: Column) -> Column:
        """Shared shingles that sets of these sizes need, as an exact integer."""
        whole = self.top + self.bottom
        return F.floor(((a + b) * self.top + (whole - 1)) / F.lit(whole))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes). Shorter texts are one shingle of all their words; without words, none."""
    for row, bounds, h, _, _ in documents(column, fold=True):
        hashes, _ = grams(h, bounds, size, _SHINGLE)
        for i in range(len(bounds) - 1):
            low, high = int(bounds[i]), int(bounds[i + 1])
            if high - low >= size:
                yield row + i, np.unique(hashes[low:high - size + 1])
            elif high > low:
                yield row + i, _SHINGLE.between(_SHINGLE.prefix(h[low:high]), np.array([0]), np.array([high - low]))
            else:
                yield row + i, h[:0]


def _survey(size: int):
    """Rows of kind 0: a document's id, set size and class; 1: shingles that are frequent here; 2: a sample of counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def counted() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            often, some = times >= 4, (keys & _SAMPLE) == 0
            keys, times, kinds = (np.concatenate((x[often], x[some])) for x in (keys, times, np.ones(len(keys), np.int32)))
            kinds[int(often.sum()):] = 2
            none = pa.nulls(len(keys))
            return pa.RecordBatch.from_pydict({"kind": pa.array(kinds), "doc_id": none.cast(pa.int64()), "row": none.cast(pa.int64()), "n": pa.array(times.astype(np.int64)), "cid": none.cast(pa.binary()), "key": pa.array(signed(keys))})

        for batch in batches:
            ids, sizes, classes = batch.column(0), [], []
            for _, found in shingle_sets(batch.column(2), size):
                sizes.append(len(found))
                classes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                held.append(found)
                count += len(found)
                if count >= _FLUSH:
                    yield counted()
                    held, count = [], 0
            rows = len(sizes)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(rows, np.int32)), "doc_id": ids, "row": batch.column(1), "n": pa.array(sizes, pa.int64()), "cid": pa.array(classes, pa.binary()), "key": pa.nulls(rows, pa.int64())})
        if count:
            yield counted()
    return run


class Order:
    """The global order of shingles: those of one set alone, then the others by hash, then frequent ones by count."""

    def __init__(self, spark, keys: np.ndarray, counts: np.ndarray, shared):
        at = np.argsort(keys)
        self._value, self._shared = spark.sparkContext.broadcast((keys[at], counts[at])), shared

    def sort(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in this order, and which of its shingles other sets may hold."""
        if not len(found):
            return found, np.zeros(0, bool)
        keys, counts = self._value.value
        shared = self._shared(found)
        rank = shared.astype(np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            rank = np.where(keys[at] == found, counts[at] + 1, rank)
        order = np.argsort(rank, kind="stable")  # sets come sorted by hash
        return found[order], shared[order]


def _keys(found: np.ndarray, shared: np.ndarray, threshold: Threshold, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, room, whether the key is a pair) of an ordered set; room is the largest overlap that a first meeting at this key allows."""
    n = len(found)
    none = np.zeros(0, np.uint64)
    if n < 2:  # one shingle: every partner is the same set
        return none, none.astype(np.int64), none.astype(bool)
    least = threshold.least(n)
    keys, room, subset = [], [], []
    if n > boundary or threshold.bottom * n >= threshold.top * (boundary + 1):
        first = np.flatnonzero(shared[:n - least + 1])
        keys.append(found[first])
        room.append(n - first)
        subset.append(np.zeros(len(first), bool))
    if n <= boundary:
        first = np.flatnonzero(shared[:n - least + 2])
        pairs = np.array(list(combinations(first.tolist(), 2)), np.int64).reshape(-1, 2)
        keys.append(mix(found[pairs[:, 0]] * np.uint64(0x9FB21C651E98DF25) + mix(found[pairs[:, 1]])))
        room.append(n - pairs[:, 1] + 1)
        subset.append(np.ones(len(pairs), bool))
    return np.concatenate(keys), np.concatenate(room), np.concatenate(subset)


def _all_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), size):
                if len(found):
                    yield found
    return run


def _members(size: int, order: Order, threshold: Threshold, boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for _, found in shingle_sets(batch.column(0), size):
                keys, room, subset = _keys(*order.sort(found), threshold, boundary)
                if len(keys):
                    held.append((keys, room, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), subset))
            if held:
                counts = [len(k) for k, *_ in held]
                classes = pa.array([c for *_, c, _ in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), counts)))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(signed(np.concatenate([k for k, *_ in held]))), "subset": pa.array(np.concatenate([s for *_, s in held])), "cid": classes,
                    "n": pa.array(np.repeat([n for _, _, n, *_ in held], counts).astype(np.int32)), "room": pa.array(np.concatenate([r for _, r, *_ in held]).astype(np.int32))})
    return run


def _class_key(cid: bytes) -> int:
    return int.from_bytes(cid[:8], "little")


def _filter_keys(column: pa.Array) -> np.ndarray:
    """64-bit keys of a column of classes, or of one of keys."""
    if pa.types.is_binary(column.type):
        return np.fromiter((_class_key(c) for c in column.to_pylist()), np.uint64, len(column))
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        keys = _filter_keys(batch.column(0))
        yield np.concatenate((keys, keys))


def _among(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``table`` whose first column may be one of ``wanted``, a stored table of one column of different values.

    The filter holds ``wanted`` alone, so rows that are not needed stay where they are; a few others pass.
    """
    test = repeated_keys(wanted, _twice, bits_for(wanted.count(), per_key=12), depth=2).reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(test(_filter_keys(batch.column(0)))))

    return table.mapInArrow(run, table.schema)


def _whole_sets(size: int, test, shared):
    """Of each class that ``test`` lets through, the size and the shingles that other sets may hold: no others can meet in a pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, sets = [], [], []
            for _, found in shingle_sets(batch.column(0), size):
                cid = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if test(np.array([_class_key(cid)], np.uint64))[0]:
                    classes.append(cid)
                    sizes.append(len(found))
                    sets.append(found[shared(found)].tobytes())
            if classes:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], ["cid", "size", "shingles"])
    return run


def _overlaps(top: int, bottom: int):
    """Each pair's decision, from sizes and common shingles in integers, and its Jaccard distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, distance = [], []
            for a, b, both in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                either = both - shared
                linked.append(bottom * shared >= top * either)
                distance.append(1 - shared / either)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())], ["u", "v", "linked", "distance"])
    return run


def _boundary(sample: DataFrame, frequent: DataFrame, threshold: Threshold) -> int:
    """The largest size up to which subsets cost less than lists; from one row of sums over the sampled shingles."""
    counts = sample.groupBy("key").agg(F.sum("n").alias("n")).join(frequent.select("key"), "key", "left_anti")
    squares, total = counts.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum("n")).first()
    met = squares / total - 1 if total else 0.0  # other members that a key's list has on average
    best = 1
    for n in range(2, _LARGEST_SMALL + 1):
        first = n - threshold.least(n) + 1
        if (first + 1) * first / 2 <= first * (1 + _TEST_COST * met):
            best = n
    return best


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    a = sets.select(F.col("cid").alias("u"), F.col("shingles").alias("su"), F.col("size").alias("nu"))
    b = sets.select(F.col("cid").alias("v"), F.col("shingles").alias("sv"), F.col("size").alias("nv"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "su", "sv", (F.col("nu") + F.col("nv")).alias("both"))
    return both.mapInArrow(_overlaps(threshold.top, threshold.bottom), "u binary, v binary, linked boolean, distance double")


def _different_lists(keys: DataFrame) -> DataFrame:
    """(key) of one list of at least two classes for each different set of classes that lists hold.

    Sets of classes are told apart by size and 128 bits. Shingles have one order everywhere, so of equal lists by single shingles, and of equal ones by
    pairs, that with the most room in all has the most for each member: no pair that another would admit is lost.
    """
    held = keys.groupBy("key", "subset").agg(F.count(F.lit(1)).alias("others"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y"), F.sum("room").alias("room"))
    best = F.max(F.struct("room", "key")).alias("best")
    return held.filter("others > 1").groupBy("subset", "others", "x", "y").agg(best).select("best.key", "subset")


def _ordered(pairs: DataFrame, threshold: Threshold) -> DataFrame:
    need = threshold.pair(F.col("n_a"), F.col("n_b"))
    enough = pairs.filter((F.col("a") != F.col("b")) & (F.least("room_a", "room_b") >= need))
    return enough.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, top: int = 3, bottom: int = 4) -> DataFrame:
    """Per row: doc_id, row (a hash of the text), n_shingles, component_id.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased; a set holds the distinct
    shingles of ``size`` words, or all words as one shingle if there are fewer. Two rows are linked when their
    Jaccard similarity is at least ``top`` / ``bottom``; component_id is the smallest id reachable by links. A
    row without words is linked with nothing. Rows that repeat an id are judged by their own text. Rows without an
    id take part; a component of such rows alone has no component_id. Extra columns are not read.
    """
    spark, threshold = docs.sparkSession, Threshold(top, bottom)
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    texts = rows.select("text")
    survey = written(rows.mapInArrow(_survey(size), "kind int, doc_id long, row long, n long, cid binary, key long"), "shingle-survey")
    people = survey.filter("kind = 0").select("doc_id", "row", "n", "cid")

    frequent = survey.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 16").orderBy(F.desc("n"), "key").limit(_FREQUENT)
    ranked = frequent.collect()  # at most _FREQUENT rows of two numbers
    boundary = _boundary(survey.filter("kind = 2"), spark.createDataFrame(ranked, "key long, n long"), threshold)

    total = people.agg(F.sum("n")).first()[0] or 0
    shared = repeated_keys(texts, _all_shingles(size), bits_for(total), depth=1, fine=fine_bits(total))
    order = Order(spark, np.array([r["key"] for r in ranked], np.int64).view(np.uint64), np.array([r["n"] for r in ranked], np.int64), shared.reader())
    raw = texts.mapInArrow(_members(size, order, threshold, boundary), "key long, subset boolean, cid binary, n int, room int")
    members = raw.groupBy("key", "subset", "cid").agg(F.max("n").alias("n"), F.max("room").alias("room"))
    keys = written(members, "keys")
    lists = written(_different_lists(keys), "lists")
    members = written(_among(keys, lists.select("key")).join(lists, ["key", "subset"]).drop("subset"), "list-members")
    discard(keys, lists)

    listed = members.select("cid").distinct()
    needed = repeated_keys(listed, _twice, bits_for(listed.count(), per_key=12), depth=4)
    sets = texts.mapInArrow(_whole_sets(size, needed.reader(), shared.reader()), "cid binary, size long, shingles binary")
    sets = written(sets.groupBy("cid").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")), "listed-sets")

    other = members.select("key", F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("room").alias("room_a"))
    centre = [F.min(F.struct(F.xxhash64("cid", F.lit(s)), "cid", "n", "room")).alias(f"c{s}") for s in range(_CENTRES)]
    chosen = members.groupBy("key").agg(*centre).select("key", F.posexplode(F.array(*[f"c{s}" for s in range(_CENTRES)])).alias("s", "c"))
    chosen = written(chosen.select("key", "s", F.col("c.cid").alias("b"), F.col("c.n").alias("n_b"), F.col("c.room").alias("room_b")), "centres")
    centres = chosen.drop("s").distinct()
    tested = written(_verified(_ordered(other.join(centres, "key"), threshold), sets, threshold), "tested-pairs")
    links = tested.filter("linked").select("u", "v")
    roots = written(connected(links), "roots")

    # pairs of a list that lie in different components: everything outside the list's largest component against all
    placed = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("key", F.col("m.root").alias("main"))
    largest = written(largest, "divided-lists")
    open_lists = written(placed.join(largest, "key"), "open-lists")
    # distances obey the triangle inequality, so two sets whose distances to a centre differ too much cannot be linked
    pairs = open_lists.select("key", "cid").join(chosen.select("key", "s", "b"), "key").select(
        "key", "cid", "s", F.least("cid", "b").alias("u"), F.greatest("cid", "b").alias("v"))
    known = pairs.join(tested.select("u", "v", "distance"), ["u", "v"]).groupBy("key", "cid").agg(*[F.max(F.when(F.col("s") == s, F.col("distance"))).alias(f"d{s}") for s in range(_CENTRES)])
    lists, open_lists = open_lists, written(open_lists.join(known, ["key", "cid"], "left"), "open-lists")
    discard(lists)
    far = [f"d{s}" for s in range(_CENTRES)]
    rest = open_lists.filter("root <> main").select("key", F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("room").alias("room_a"), F.col("root").alias("root_a"), *[F.col(d).alias(f"{d}_a") for d in far])
    every = open_lists.select("key", F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("room").alias("room_b"), F.col("root").alias("root_b"), *[F.col(d).alias(f"{d}_b") for d in far])
    need = threshold.pair(F.col("n_a"), F.col("n_b"))
    possible = (F.col("root_a") != F.col("root_b")) & (F.least("room_a", "room_b") >= need)
    for d in far:
        possible &= F.coalesce(F.abs(F.col(f"{d}_a") - F.col(f"{d}_b")) <= 1 - top / bottom + 1e-9, F.lit(True))
    apart = rest.join(every, (rest["key"] == every["key"]) & possible)
    missing = written(_ordered(apart, threshold).join(tested, ["u", "v"], "left_anti"), "missing-pairs")
    ends = written(missing.select(F.explode(F.array("u", "v")).alias("cid")).distinct(), "missing-ends")
    links = written(links.unionByName(_verified(missing, _among(sets, ends), threshold).filter("linked").select("u", "v")), "links")
    discard(members, sets, chosen, tested, roots, largest, open_lists, missing, ends)
    roots = connected(links)

    smallest = F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("first")
    classes = people.filter("n > 0").groupBy("cid").agg(smallest)
    classes = written(classes, "classes")
    joined = roots.join(classes, F.col("node") == F.col("cid")).select("cid", "root", "first")
    whole = joined.join(joined.groupBy("root").agg(F.min("first").alias("least")), "root").select("cid", "least")
    labels = written(classes.join(whole, "cid", "left").select("cid", F.coalesce("least", "first").alias("label")), "labels")
    out = people.join(labels, "cid", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("label") < (1 << 63) - 1, F.col("label"))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is their component's; the others have a near copy that stays.

    Rows that repeat an id and a text are one document and stay together. Rows without an id stay unless one with an id is linked.
    """
    found = jaccard_components(docs).filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without(docs, found, "near-copies")
