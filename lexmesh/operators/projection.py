"""Two-dimensional views of embeddings: principal components, ellipses, word-position points."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import WORD_INITIAL
from lexmesh.operators.scripts import MIXED_GROUP


def fit_pca(vectors: DataFrame, components: int = 2) -> tuple[StandardScalerModel, PCAModel, list[float]]:
    """Fit on centred vectors; signs make each component's largest coefficient positive."""
    rows = vectors.select(array_to_vector("vector").alias("raw"))
    centre = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(rows)
    model = PCA(k=components, inputCol="centred", outputCol="scores").fit(centre.transform(rows))
    loadings = model.pc.toArray()  # dims x components
    signs = [float(np.sign(column[np.argmax(np.abs(column))]) or 1.0) for column in loadings.T]
    return centre, model, signs


def project_pca(vectors: DataFrame, fitted: tuple[StandardScalerModel, PCAModel, list[float]]) -> DataFrame:
    """Replace ``vector`` by ``pc1, pc2, ...``."""
    centre, model, signs = fitted
    others = [c for c in vectors.columns if c != "vector"]
    scored = model.transform(centre.transform(vectors.withColumn("raw", array_to_vector("vector"))))
    scores = vector_to_array("scores")
    return scored.select(*others, *[(F.get(scores, F.lit(i)) * sign).alias(f"pc{i + 1}") for i, sign in enumerate(signs)])


def confidence_ellipse(points: DataFrame, by: str = "script", n_std: float = 3.0) -> DataFrame:
    """Ellipse parameters per group of more than two ``(x, y)`` points; one combining aggregation."""
    stats = points.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.var_samp("x").alias("_vx"), F.var_samp("y").alias("_vy"), F.covar_samp("x", "y").alias("_c")).filter(F.col("n") > 2)
    flat = (F.col("_vx") == 0) | (F.col("_vy") == 0)
    r = F.when(~flat, F.least(F.greatest(F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy")), F.lit(-1.0)), F.lit(1.0)))
    return stats.withColumn("pearson", r).select(
        by, "n", "mean_x", "mean_y", "pearson", F.sqrt(1 + F.col("pearson")).alias("radius_x"), F.sqrt(1 - F.col("pearson")).alias("radius_y"),
        (F.sqrt("_vx") * n_std).alias("scale_x"), (F.sqrt("_vy") * n_std).alias("scale_y"))


def word_position_points(points: DataFrame) -> DataFrame:
    """Points ``(token, category, ...)`` tagged Initial or Medial, once per view they appear in."""
    position = F.when(F.col("token").startswith(WORD_INITIAL), "Initial").otherwise("Medial")
    mixed = F.when(F.col("category").isin(*MIXED_GROUP), F.lit("/".join(MIXED_GROUP)))
    views = F.array_compact(F.array(F.lit("All scripts"), mixed, F.col("category")))
    return points.withColumn("word_position", position).withColumn("view", F.explode(views))
