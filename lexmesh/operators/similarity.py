"""Similarity-weighted initialisation: new rows as sparse combinations of overlapping tokens' rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold_of(values: np.ndarray) -> float:
    """Sparsemax threshold t: the values above t, less t, sum to one."""
    ordered = np.sort(values)[::-1]
    running = np.cumsum(ordered)
    size = np.arange(1, len(ordered) + 1)
    support = ordered * size > running - 1.0
    k = int(size[support][-1])
    return float((running[k - 1] - 1.0) / k)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype("float64")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _rows(ids: pd.Series, name: str, values: list) -> pd.DataFrame:
    return pd.DataFrame({"id": ids.to_numpy(), name: pd.Series(values, dtype="object")})


def _tiles(rows: DataFrame, own: str, other: str, own_tiles: int, other_tiles: int) -> DataFrame:
    return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_tiles)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(other_tiles - 1))))


def init_by_similarity(new: DataFrame, overlap: DataFrame, tile: int = 4096) -> DataFrame:
    """Rows for tokens that only the new vocabulary has.

    ``new`` is ``(id, aux)``, ``overlap`` is ``(id, aux, vector)``. Weights are the sparsemax of the
    cosine similarities of the auxiliary vectors to all overlapping tokens. The similarity matrix is
    computed tile by tile, as in a blocked matrix product; no pair is ever a row. The first pass
    sends, per tile, only similarities above that tile's own threshold, which cannot exceed the
    threshold over all tiles; the second pass sends weighted partial sums.
    """
    new_tiles = max(1, -(-new.count() // tile))
    old_tiles = max(1, -(-overlap.count() // tile))
    # toDF gives every use of an input its own columns, so that no cogroup or join is ambiguous
    left = _tiles(new.select("id", "aux").toDF("id", "aux"), "i", "j", new_tiles, old_tiles)
    right = _tiles(overlap.select("id", "aux").toDF("id", "aux"), "j", "i", old_tiles, new_tiles)  # vectors are not needed yet

    def candidates(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _rows(a["id"][:0], "near", [])
        similar = _unit_rows(a["aux"]) @ _unit_rows(b["aux"]).T
        return _rows(a["id"], "near", [row[row > threshold_of(row)] for row in similar])

    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(candidates, "id long, near array<double>")

    @F.pandas_udf("double")
    def threshold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: threshold_of(np.asarray(v)))

    cuts = near.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near")).select("id", threshold("near").alias("cut"))
    weighted = _tiles(new.select("id", "aux").toDF("id", "aux").join(cuts, "id"), "i", "j", new_tiles, old_tiles)

    again = _tiles(overlap.select("id", "aux", "vector").toDF("id", "aux", "vector"), "j", "i", old_tiles, new_tiles)

    def partial_sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _rows(a["id"][:0], "part", [])
        weights = np.maximum(_unit_rows(a["aux"]) @ _unit_rows(b["aux"]).T - a["cut"].to_numpy()[:, None], 0.0)
        sums = weights @ np.stack(b["vector"].to_numpy()).astype("float64")
        used = weights.any(axis=1)
        return _rows(a["id"][used], "part", list(sums[used]))

    parts = weighted.groupBy("i", "j").cogroup(again.groupBy("i", "j")).applyInPandas(partial_sums, "id long, part array<double>")
    return parts.groupBy("id").agg(Summarizer.sum(array_to_vector("part")).alias("v")).select("id", vector_to_array("v").alias("vector"))
