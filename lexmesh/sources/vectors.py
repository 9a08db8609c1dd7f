"""Vocabularies with their embedding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def load_vocab_embeddings(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vocabulary ``(token, id, ...)`` joined to the matrix ``(id, vector)``."""
    return vocab.join(vectors.select("id", "vector"), "id")
