"""Embedding statistics and initialisation of a new vocabulary's matrix from an old one."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.hashing import normal
from lexmesh.operators.scripts import SPECIAL_CATEGORY, is_special, script_categories
from lexmesh.operators.similarity import init_by_similarity
from lexmesh.session import lookup


def _summary(vectors: DataFrame, *by: str) -> DataFrame:
    """Row count, mean and sample standard deviation vectors per group, combined per task."""
    metrics = Summarizer.metrics("count", "mean", "std").summary(array_to_vector(F.col("vector").cast("array<double>")))
    grouped = vectors.groupBy(*by).agg(metrics.alias("s"))
    std = F.when(F.col("s.count") > 1, vector_to_array("s.std"))
    return grouped.select(*by, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"), std.alias("std"))


def category_moments(members: DataFrame) -> DataFrame:
    """Mean and sample standard deviation vectors per category of ``(category, vector)`` rows.

    A category holding a third of all rows is one buffer per task before the shuffle. A single
    member has no standard deviation.
    """
    return _summary(members, "category")


def overall_moments(vectors: DataFrame) -> DataFrame:
    return _summary(vectors)


def moments_by_dim(moments: DataFrame) -> DataFrame:
    """Moment vectors as one row per dimension."""
    others = [c for c in moments.columns if c not in ("mean", "std")]
    spread = moments.select(*others, "std", F.posexplode("mean").alias("dim", "mean"))
    return spread.select(*others, "dim", "mean", F.get("std", F.col("dim")).alias("std"))


def moment_vectors(moments: DataFrame) -> DataFrame:
    """Moments to draw from: a missing standard deviation becomes 0."""
    flat = F.transform("mean", lambda x: F.lit(0.0))
    return moments.select("category", "mean", F.coalesce("std", flat).alias("std"))


def random_vector(dims: int, seed: int, key: Column | str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: normal(seed, F.lit("start"), key, i))


def category_vector(seed: int, key: Column | str, mean: str = "mean", std: str = "std") -> Column:
    """A draw from the per-dimension normal of a category."""
    index = F.sequence(F.lit(0), F.size(mean) - 1)
    return F.zip_with(index, F.arrays_zip(F.col(mean).alias("m"), F.col(std).alias("s")),
                      lambda i, x: x["m"] + x["s"] * normal(seed, F.lit("category"), key, i))


def init_random(vocab: DataFrame, dims: int, seed: int = 1) -> DataFrame:
    return vocab.select("token", "id", random_vector(dims, seed, "id").alias("vector"))


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def copy_special(old: DataFrame, new_vocab: DataFrame) -> DataFrame:
    """Rows of the special tokens, under their new ids. ``old`` is ``(token, vector)``."""
    wanted = new_vocab.filter(is_special(F.col("token"))).select("token", "id")
    rows = old.filter(is_special(F.col("token"))).select("token", _doubles(F.col("vector")).alias("vector"))
    return wanted.join(rows, "token")


def init_by_identity(old: DataFrame, new_vocab: DataFrame) -> DataFrame:
    """Tokens of both vocabularies, special ones aside, with the old row."""
    rows = old.filter(~is_special(F.col("token"))).select("token", _doubles(F.col("vector")).alias("vector"))
    return new_vocab.select("token", "id").join(rows, "token")


def _moments_by_category(old: DataFrame, old_categories: DataFrame) -> DataFrame:
    members = old_categories.join(old.select("id", "vector"), "id")
    found = members.filter(F.col("category") != SPECIAL_CATEGORY)
    return moment_vectors(category_moments(found))


def init_by_category(old: DataFrame, old_categories: DataFrame, new_categories: DataFrame, seed: int = 1) -> DataFrame:
    """Draws for the new tokens whose category also occurs in the old vocabulary.

    Moments are one row per script and position, a number Unicode bounds, and are broadcast.
    """
    moments = F.broadcast(_moments_by_category(old, old_categories))
    tokens = new_categories.filter(F.col("category") != SPECIAL_CATEGORY)
    return tokens.join(moments, "category").select("token", "id", "category", category_vector(seed, "id").alias("vector"))


def init_combined(old: DataFrame, new_vocab: DataFrame, dims: int, by_script: bool = False, by_position: bool = False,
                  by_identity: bool = False, seed: int = 1, table: DataFrame | None = None,
                  reproduce_special_overwrite: bool = False, auxiliary: DataFrame | None = None) -> DataFrame:
    """A full new matrix ``(token, id, origin, vector)`` in one pass over the new vocabulary.

    Precedence: identity, special rows, similarity, script draw, random start. ``old`` is ``(token, id, vector)``.
    ``auxiliary`` vectors ``(id, aux)`` of the new vocabulary ask for similarity: tokens of both vocabularies keep their
    old rows, and new ones become weighted means of these.
    By default the special rows stay copies; ``reproduce_special_overwrite`` lets a script draw
    replace them.
    """
    if by_position and not by_script:
        raise ValueError("by_position needs by_script")
    token = F.col("token")
    same = old.select("token", _doubles(F.col("vector")).alias("_same"))
    rows = new_vocab.select("token", "id").join(same, "token", "left")
    script = F.lit(False)
    if by_script:
        new_categories = script_categories(new_vocab, by_position, table).filter(F.col("category") != SPECIAL_CATEGORY)
        moments = F.broadcast(_moments_by_category(old, script_categories(old, by_position, table)))
        rows = rows.join(new_categories.select("id", "category"), "id", "left").join(moments, "category", "left")
        script = F.col("mean").isNotNull()
        if not reproduce_special_overwrite:
            script = script & ~is_special(token)
    similar = F.lit(False)
    if auxiliary is not None:
        described = new_vocab.select("token", "id").join(auxiliary.select("id", "aux"), "id")
        overlap = described.join(same.withColumnRenamed("_same", "vector"), "token").select("id", "aux", "vector")
        missing = described.join(same.select("token"), "token", "left_anti").select("id", "aux")
        rows = rows.join(init_by_similarity(missing, overlap).withColumnRenamed("vector", "_similar"), "id", "left")
        similar = F.col("_similar").isNotNull()
    origin = (F.when(is_special(token) & F.col("_same").isNotNull() & ~script, "special")
              .when(F.lit(by_identity or auxiliary is not None) & ~is_special(token) & F.col("_same").isNotNull(), "identity")
              .when(similar, "similarity")
              .when(script, "script").otherwise("random"))
    rows = rows.withColumn("origin", origin)
    drawn = F.when(F.col("origin").isin("special", "identity"), F.col("_same"))
    if auxiliary is not None:
        drawn = drawn.when(F.col("origin") == "similarity", F.col("_similar"))
    if by_script:
        drawn = drawn.when(F.col("origin") == "script", category_vector(seed, "id"))
    return rows.select("token", "id", "origin", drawn.otherwise(random_vector(dims, seed, "id")).alias("vector"))


def matched_tokens(old: DataFrame, new_vocab: DataFrame) -> DataFrame:
    """How many tokens of the new vocabulary the old one has: ``matched``, ``new_tokens`` and their ``share``."""
    both = new_vocab.select("token").join(old.select("token", F.lit(1).alias("_hit")), "token", "left")
    counts = both.agg(F.count("_hit").alias("matched"), F.count(F.lit(1)).alias("new_tokens"))
    return counts.withColumn("share", F.try_divide(F.col("matched"), F.col("new_tokens")))


# The flag sets offered as presets.
PRESETS = {
    "script": {"by_script": True},
    "identity": {"by_identity": True},
    "script+identity": {"by_script": True, "by_identity": True},
    "script+position": {"by_script": True, "by_position": True},
    "script+pos+ident": {"by_script": True, "by_position": True, "by_identity": True},
}


def pool_word_vectors(alignment: DataFrame, pieces: DataFrame, broadcast_rows: int = 1 << 20) -> DataFrame:
    """Mean of each word's subword vectors.

    ``alignment`` is ``(word keys..., id)``, ``pieces`` ``(id, vector)``. Words are shuffled with their ids alone; up to
    ``broadcast_rows`` vectors are broadcast to them, more are joined by shuffle.
    """
    keys = [c for c in alignment.columns if c != "id"]
    words = alignment.groupBy(*keys).agg(F.collect_list("id").alias("_ids")).select(*keys, F.explode("_ids").alias("id"))
    rows = lookup(words, pieces.select("id", "vector"), ["id"], broadcast_rows=broadcast_rows)
    rows = rows.select(*keys, array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    return rows.groupBy(*keys).agg(Summarizer.mean(F.col("v")).alias("v")).select(*keys, vector_to_array("v").alias("vector"))
