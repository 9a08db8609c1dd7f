"""Exponent-weighted rebalancing of languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.hashing import uniform
from lexmesh.functions.numbering import rank_by_hash
from lexmesh.session import lookup


def _everything() -> Window:
    # only ever applied to a table with one row per language
    return Window.partitionBy(F.lit(0))


def file_order() -> Window:
    """The files before a file, over a table with one row per file."""
    return Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)


def language_composition(lines: DataFrame) -> DataFrame:
    counts = lines.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"))
    return counts.withColumn("proportion", F.col("lines") / F.sum("lines").over(_everything()))


def alpha_weights(composition: DataFrame, alpha: float) -> DataFrame:
    """Sampling probability of each language: proportion^alpha, renormalised."""
    powered = composition.withColumn("_power", F.pow("proportion", F.lit(float(alpha))))
    return powered.withColumn("weight", F.col("_power") / F.sum("_power").over(_everything())).drop("_power")


def sampling_rates(weights: DataFrame) -> DataFrame:
    """Up- or down-sampling factor of each language."""
    return weights.withColumn("rate", F.col("weight") / F.col("proportion"))


def sample_languages(lines: DataFrame, alpha: float, key: Sequence[str], size: int | None = None, seed: int = 1) -> DataFrame:
    """``size`` draws with replacement: a language by its weight, then a uniform line of it.

    The language of a draw comes from a cumulative array with one entry per language; the line is
    fetched by an equi-join on (language, index), whose keys are uniform within each language.
    """
    weights = alpha_weights(language_composition(lines), alpha)
    rows = size if size is not None else lines.count()
    by_name = _everything().orderBy("lang")
    upto = F.sum("weight").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    ladder = weights.select(
        F.when(F.lead("lang").over(by_name).isNull(), F.lit(2.0)).otherwise(upto).alias("upto"),
        "lang", "lines")
    steps = ladder.agg(F.array_sort(F.collect_list(F.struct("upto", "lang", "lines")))).scalar()
    chance = lines.sparkSession.range(rows).select(
        F.col("id").alias("draw"), steps.alias("steps"), uniform(seed, F.lit("language"), "id").alias("u"))
    draws = chance.select("draw", F.element_at(F.filter("steps", lambda s: s["upto"] > F.col("u")), 1).alias("pick"))
    draws = draws.select(
        "draw", F.col("pick.lang").alias("lang"),
        (F.floor(uniform(seed, F.lit("line"), "draw") * F.col("pick.lines")) + 1).cast("long").alias("_index"))
    indexed = rank_by_hash(lines, seed, key, by=["lang"], name="_index")
    return draws.join(indexed, ["lang", "_index"]).drop("_index")


_LARGEST_MEAN = 32.0


def poisson_ladder(rates: DataFrame) -> DataFrame:
    """Per language the number of equal parts of its mean, and the distribution function of one part.

    A Poisson number is the sum of independent ones over the parts of its mean. No part is above ``_LARGEST_MEAN``, so a
    ladder has at most 130 steps and ends where the function is 1 in double precision, whatever the mean.
    """
    parts = F.greatest(F.ceil(F.col("mean") / F.lit(_LARGEST_MEAN)), F.lit(1))
    split = rates.select("lang", parts.cast("int").alias("parts"), (F.col("mean") / parts).alias("mean"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30)
    terms = split.select("lang", "parts", "mean", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    upto = Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto)
    terms = terms.withColumn("p", F.exp(F.col("k") * F.log("mean") - F.col("mean") - log_factorial))
    cumulative = terms.withColumn("cdf", F.sum("p").over(upto))
    return cumulative.groupBy("lang", "parts").agg(F.array_sort(F.collect_list("cdf")).alias("ladder"))


def sample_languages_rate(lines: DataFrame, alpha: float, key: Sequence[str], size: int | None = None, seed: int = 1) -> DataFrame:
    """Scale form of ``sample_languages``: each line is repeated Poisson(rate) times.

    No line is shuffled; the size is met in expectation. ``copy`` numbers the repeats from 1. The draw of a
    line's first part is that of its key, further parts have draws of their own.
    """
    weights = alpha_weights(language_composition(lines), alpha)
    wanted = F.lit(float(size)) if size is not None else F.sum("lines").over(_everything()).cast("double")
    ladders = poisson_ladder(weights.withColumn("mean", F.col("weight") * wanted / F.col("lines")))
    drawn = lookup(lines, ladders, ["lang"])

    def copies(chance: Column) -> Column:
        return F.size(F.filter("ladder", lambda c: c <= chance))

    further = F.aggregate(F.when(F.col("parts") > 1, F.sequence(F.lit(2), F.col("parts"))).otherwise(F.array().cast("array<int>")), F.lit(0),
                          lambda sum_, part: sum_ + copies(uniform(seed, F.lit("copies"), part, *key)))
    repeated = drawn.withColumn("_copies", copies(uniform(seed, F.lit("copies"), *key)) + further).filter(F.col("_copies") > 0)
    return repeated.drop("ladder", "parts").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
