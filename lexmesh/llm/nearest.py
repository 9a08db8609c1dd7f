"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

The trees are grown on a bounded sample, one task a tree; every row is then sent down all trees, so every row is
indexed. Largest inner product becomes smallest angle by one more coordinate, which lifts all rows to
the same length. A query pops leaves of all trees from one queue, nearest boundary first, until the leaves hold as many rows
as the search budget asks for. Leaves are cut into blocks of bounded size; queries and rows of a block meet in a
matrix product, of which only each query's best survive, scored again in double precision on the original vectors. No
pair becomes a row of its own, and equal vectors are one row that carries its smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.storage import written

SAMPLE = 1 << 15
TREES = 8
LEAF = 128
SHARE = 1.0
BLOCK = 2048


def _usable(dims: int):
    """One row per distinct vector of a batch with its ids, smallest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, set[int]] = {}
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not value.is_valid or len(value.values) != dims or value.values.null_count:
                    continue
                vector = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
                if np.isfinite(vector).all() and vector.any():
                    groups.setdefault(vector.tobytes(), set()).add(i)
            if groups:
                yield pa.RecordBatch.from_pydict({"vector": pa.array(groups, pa.binary()), "ids": pa.array([sorted(g) for g in groups.values()], pa.list_(pa.int64()))})
    return run


def distinct_vectors(parts: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): each distinct usable vector with its ``keep`` smallest ids.

    A vector's copies all have the same score for any query, and ties go to smaller ids, so further ids can never be
    among the nearest. They are combined in each task and then in two steps, so a vector that is a third of all
    rows is never gathered in one place. Rows that repeat an id are one before anything is cut off.
    """
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    spread = parts.select("vector", F.slice(F.array_distinct("ids"), 1, keep).alias("ids")).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(64)))
    return spread.groupBy("vector", "part").agg(least).groupBy("vector").agg(least)


def _array(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def _lift(x: np.ndarray, radius: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(radius * radius - np.einsum("ij,ij->i", x, x), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _grow(radius: float, leaf: int, seed: int):
    """A tree over one copy of the sample: each node splits at the median along the difference of two points."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        points = _lift(_array(frame["vector"].sort_values()), radius)
        random, nodes = np.random.default_rng((seed, tree)), [None]
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, members = todo.pop()
            nodes[at] = (tree, at, -1, -1, 0.0, b"")
            if len(members) <= leaf:
                continue
            x = points[members]
            a, b = x[random.choice(len(members), 2, replace=False)]
            normal = (a - b) / max(np.linalg.norm(a - b), 1e-300)
            side = x @ normal
            cut = float(np.median(side))
            low = side <= cut
            if low.all():  # the median is the largest value
                low = side < cut
                if not low.any():
                    continue
                cut = float(side[low].max())
            left, right = len(nodes), len(nodes) + 1
            nodes += [None, None]
            nodes[at] = (tree, at, left, right, cut, normal.tobytes())
            todo += [(left, members[low]), (right, members[~low])]
        return pd.DataFrame(nodes, columns=["tree", "node", "left", "right", "cut", "normal"])
    return run


class Forest:
    """Tree nodes as arrays. Its size is bounded by the sample, not by the rows."""

    def __init__(self, rows: list, dims: int):
        self.trees = []
        for tree in sorted({r["tree"] for r in rows}):
            own = sorted((r for r in rows if r["tree"] == tree), key=lambda r: r["node"])
            blank = np.zeros(dims)
            self.trees.append((np.array([r["left"] for r in own]), np.array([r["right"] for r in own]), np.array([r["cut"] for r in own]),
                               np.stack([np.frombuffer(bytes(r["normal"]), np.float64) if len(r["normal"]) else blank for r in own])))

    def leaves(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), len(self.trees)), np.int32)
        for t, (left, right, cut, normal) in enumerate(self.trees):
            at = np.zeros(len(points), np.int64)
            inner = np.arange(len(points))
            while len(inner := inner[left[at[inner]] >= 0]):
                node = at[inner]
                side = np.einsum("ij,ij->i", points[inner], normal[node])
                at[inner] = np.where(side <= cut[node], left[node], right[node])
            out[:, t] = at
        return out

    def search(self, point: np.ndarray, sizes: dict[tuple[int, int], int], budget: int) -> list[tuple[int, int]]:
        """Leaves of all trees from one queue, by the squared distances to the boundaries crossed, until they hold ``budget`` rows."""
        sides = [normal @ point for _, _, _, normal in self.trees]
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        found, held = [], 0
        while queue and held < budget:
            far, t, node = heapq.heappop(queue)
            left, right, cut, _ = self.trees[t]
            while left[node] >= 0:
                gap = sides[t][node] - cut[node]
                near, other = (left[node], right[node]) if gap <= 0 else (right[node], left[node])
                heapq.heappush(queue, (far + gap * gap, t, int(other)))
                node = int(near)
            if rows := sizes.get((t, node), 0):
                found.append((t, node))
                held += rows
        return found


def _routed(forest_of, radius: float, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest_of.value.leaves(_lift(_array(batch["vector"].to_pylist()), radius))
                take = pa.array(np.repeat(np.arange(batch.num_rows), trees))
                yield pa.RecordBatch.from_pydict({"tree": pa.array(np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)), "leaf": pa.array(leaves.ravel()),
                                                  "vector": batch["vector"].take(take), "ids": batch["ids"].take(take)})
    return run


def _probes(forest_of, sizes_of, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, vector in zip(batch["query"].to_pylist(), batch["vector"].to_pylist()):
                hit = forest_of.value.search(np.append(np.frombuffer(vector, np.float64), 0.0), sizes_of.value, budget)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t for t, _ in hit], pa.int32()), "leaf": pa.array([n for _, n in hit], pa.int32()),
                                                  "query": pa.array([query] * len(hit), pa.int64()), "vector": pa.array([vector] * len(hit), pa.binary())})
    return run


def _score(keep: int):
    """The best rows of one block for each query of one block: found by a product, scored on the original vectors."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = {"query": pa.int64(), "score": pa.float64(), "ids": pa.list_(pa.int64())}
        if not rows.num_rows or not queries.num_rows:
            return pa.Table.from_pydict({n: pa.array([], t) for n, t in names.items()})
        x, y = _array(queries["vector"].to_pylist()), _array(rows["vector"].to_pylist())
        rough = x @ y.T
        count = min(keep, len(y))
        # a margin far above the rounding of the product, so that the exact order decides at the edge
        edge = np.partition(rough, len(y) - count, axis=1)[:, len(y) - count] - 1e-9 * (np.abs(x).max() * np.abs(y).max() * x.shape[1])
        q, r = np.nonzero(rough >= edge[:, None])
        exact = np.einsum("ij,ij->i", x[q], y[r])
        return pa.Table.from_pydict({"query": queries["query"].combine_chunks().take(pa.array(q)), "score": pa.array(exact), "ids": rows["ids"].combine_chunks().take(pa.array(r))})
    return run


def _blocks(df: DataFrame, sizes: DataFrame, block: int, own: str, other: str, spread) -> DataFrame:
    """Each row in one of its leaf's own blocks and, once, opposite each block of the other side."""
    sized = df.join(sizes, ["tree", "leaf"])
    placed = sized.withColumn(own, F.pmod(spread, F.ceil(F.col(f"n_{own}") / block)).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.ceil(F.col(f"n_{other}") / block).cast("int") - 1)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, share: float = SHARE,
            block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The ``k`` nearest rows found for each query by largest inner product: query_id, rank, vec_id, score.

    Both frames are (vec_id, embedding). A row is never its own neighbour (rows that share an id count as one row); equal scores go
    to the smaller id; fewer than ``k`` candidates are all returned. Null ids and vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no part. ``sample`` bounds the vectors that
    trees are grown on; all rows are indexed. ``share`` of the distinct vectors, counted over all trees, is what a
    query looks at (trees repeat each other, so less than that is distinct), and two leaves a tree at least.
    """
    spark = vectors.sparkSession
    none = "query_id long, rank int, vec_id long, score double"
    pick = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = vectors.groupBy(F.size("embedding").alias("dims")).count().filter("dims > 0").orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return spark.createDataFrame([], none)
    dims = lengths["dims"]
    index = written(distinct_vectors(pick(vectors).mapInArrow(_usable(dims), "vector binary, ids array<long>"), k + 1), "vectors")
    # one row per query row; equal query vectors are searched once, under the smallest of their ids
    asked = pick(queries).mapInArrow(_usable(dims), "vector binary, ids array<long>")
    people = written(asked.select("vector", F.explode("ids").alias("query_id")).distinct(), "queries")
    searched = written(people.groupBy("vector").agg(F.min("query_id").alias("query")), "searched")

    rows = index.count()
    if not rows:
        return spark.createDataFrame([], none)
    norms = index.mapInArrow(_norms, "norm double").agg(F.max("norm")).first()[0]
    radius = float(np.sqrt(norms))
    chosen = index.orderBy(F.xxhash64("vector", F.lit(seed)), "vector").limit(sample).select("vector")
    copies = chosen.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    grown = copies.groupBy("tree").applyInPandas(_grow(radius, leaf, seed), "tree int, node int, left int, right int, cut double, normal binary")
    forest = spark.sparkContext.broadcast(Forest(grown.collect(), dims + 1))  # at most trees * sample / leaf * 4 nodes

    routed = written(index.mapInArrow(_routed(forest, radius, trees), "tree int, leaf int, vector binary, ids array<long>"), "leaves")
    sizes = routed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n_row"))
    counted = spark.sparkContext.broadcast({(r["tree"], r["leaf"]): r["n_row"] for r in sizes.collect()})  # one entry per leaf
    probes = written(searched.mapInArrow(_probes(forest, counted, max(2 * trees * leaf, int(share * rows))), "tree int, leaf int, query long, vector binary"), "probes")
    both = written(sizes.join(probes.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n_query")), ["tree", "leaf"]), "leaf-sizes")

    keys = ["tree", "leaf", "row", "query_block"]
    left = _blocks(routed, both.withColumnRenamed("n_query", "n_query_block"), block, "row", "query_block", F.xxhash64("vector"))
    right = _blocks(probes, both.withColumnRenamed("n_query", "n_query_block"), block, "query_block", "row", F.xxhash64("query"))
    met = left.select(*keys, "vector", "ids").groupBy(*keys).cogroup(right.select(*keys, "query", "vector").groupBy(*keys)).applyInArrow(
        _score(k + 1), "query long, score double, ids array<long>")
    best = met.groupBy("query").applyInArrow(_best(k + 1), "query long, vec_ids array<long>, scores array<double>")
    placed = people.join(searched, "vector").join(best, "query")
    others = F.slice(F.filter(F.arrays_zip("vec_ids", "scores"), lambda x: x["vec_ids"] != F.col("query_id")), 1, k)
    return placed.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _array(batch["vector"].to_pylist())
            yield pa.RecordBatch.from_pydict({"norm": pa.array([float(np.einsum("ij,ij->i", x, x).max())])})


def _best(keep: int):
    def run(table: pa.Table) -> pa.Table:
        found = {}
        for score, ids in zip(table["score"].to_pylist(), table["ids"].to_pylist()):
            found.update((i, max(score, found.get(i, score))) for i in ids)
        top = heapq.nsmallest(keep, found.items(), key=lambda x: (-x[1], x[0]))
        return pa.Table.from_pydict({"query": pa.array([table["query"][0].as_py()], pa.int64()), "vec_ids": pa.array([[i for i, _ in top]], pa.list_(pa.int64())),
                                     "scores": pa.array([[s for _, s in top]], pa.list_(pa.float64()))})
    return run
