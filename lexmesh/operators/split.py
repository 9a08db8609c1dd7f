"""Shuffles, splits, shards and sentence sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.numbering import head_per_group, number_rows, rank_by_hash
from lexmesh.functions.sections import number_sections
from lexmesh.functions.text import strip


def seeded_shuffle(df: DataFrame, key: Sequence[str], seed: int = 1, name: str = "position") -> DataFrame:
    """Each row's place in a seeded random permutation; write with ``orderBy(position)``."""
    return rank_by_hash(df, seed, key, name=name)


def split_ratio(df: DataFrame, key: Sequence[str], train: float, dev: float, seed: int = 1, position: str | None = None) -> DataFrame:
    """Shares of the seeded shuffle; ``position`` names a column for the place in it, in which order to write."""
    if not (0 < train < 1 and 0 < dev < 1 and train + dev <= 1):
        raise ValueError("need 0 < train, dev < 1 and train + dev <= 1")
    ranked = rank_by_hash(df, seed, key, name="_rank", total="_n")
    first, second = F.ceil(F.col("_n") * train), F.ceil(F.col("_n") * dev)
    split = (F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= first + second, "dev").otherwise("test"))
    return _placed(ranked.withColumn("split", split), position)


def _placed(ranked: DataFrame, position: str | None) -> DataFrame:
    return ranked.drop("_n").withColumnRenamed("_rank", position) if position else ranked.drop("_rank", "_n")


def split_absolute(df: DataFrame, key: Sequence[str], dev: int, test: int, seed: int = 1, position: str | None = None) -> DataFrame:
    """The last ``dev + test`` rows of the shuffle become dev, then test; ``position`` as for ``split_ratio``."""
    if dev + test <= 0:
        raise ValueError("dev + test must be positive")
    ranked = rank_by_hash(df, seed, key, name="_rank", total="_n")
    short = F.raise_error(F.lit("fewer rows than dev + test"))
    split = (F.when(F.col("_n") < dev + test, short.cast("string"))
             .when(F.col("_rank") <= F.col("_n") - (dev + test), "train")
             .when(F.col("_rank") <= F.col("_n") - test, "dev").otherwise("test"))
    return _placed(ranked.withColumn("split", split), position)


def split_threshold(df: DataFrame, key: Sequence[str], by: Sequence[str] = (), threshold: int = 1792, min_dev: int = 256,
                    min_test: int = 512, dev_size: float = 0.05, test_size: float = 0.1, seed: int = 1) -> DataFrame:
    """Small groups become test only; others get shares raised to the minimum sizes."""
    ranked = rank_by_hash(df, seed, key, by=by, name="_rank", total="_n")
    n = F.col("_n")
    test_share = F.greatest(F.lit(float(test_size)), F.lit(float(min_test)) / n)
    dev_share = F.greatest(F.lit(float(dev_size)), F.lit(float(min_dev)) / n)
    tests = F.ceil(test_share * n)
    # the dev share is taken of what the test cut leaves; a share of 1 leaves nothing to divide
    devs = F.when(test_share < 1, F.ceil(dev_share / (F.lit(1.0) - test_share) * (n - tests))).otherwise(F.lit(0))
    split = (F.when(n < threshold, "test").when(F.col("_rank") <= tests, "test")
             .when(F.col("_rank") <= tests + devs, "dev").otherwise("train"))
    return ranked.withColumn("split", split).drop("_rank", "_n")


def pool_train_dev(split: DataFrame, by: str = "lang") -> DataFrame:
    """Train and dev rows of all languages pooled; languages kept whole as test do not appear."""
    return split.filter(F.col("split").isin("train", "dev")).drop(by)


def combine_and_resplit(df: DataFrame, langs: Sequence[str], name: str, key: Sequence[str], **options) -> DataFrame:
    """Pool the chosen languages under one dataset name and split the pool."""
    pooled = df.filter(F.col("lang").isin(*langs))
    return split_threshold(pooled, key, **options).withColumn("dataset", F.lit(name))


def split_size_report(split: DataFrame, by: Sequence[str] = ("lang",)) -> DataFrame:
    sizes = split.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def group_sentences(lines: DataFrame, drop_unterminated: bool = True) -> DataFrame:
    """Blank-separated blocks: ``block_no`` per line; a last block without a closing blank is dropped."""
    stripped = lines.withColumn("line", strip(F.col("line")))
    blank = F.col("line") == ""
    keys = stripped.select("file", "line_no", blank.alias("_blank"), (~blank).alias("_counted"), "line", *(c for c in lines.columns if c not in ("file", "line_no", "line")))
    found = number_sections(keys, open_sections=drop_unterminated).withColumnRenamed("section", "block_no")
    if drop_unterminated:
        found = found.filter(F.col("ends"))
    return found.filter(F.col("line") != "").select(*lines.columns, "block_no")


def count_sentences(lines: DataFrame) -> DataFrame:
    return sentence_keys(group_sentences(lines)).agg(F.count(F.lit(1)).alias("sentences"))


def sentence_keys(sentences: DataFrame) -> DataFrame:
    return sentences.select("file", "block_no").distinct()


def downsample_sentences(sentences: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Lines of ``size`` randomly chosen sentences."""
    chosen = rank_by_hash(sentence_keys(sentences), seed, ["file", "block_no"], keep=size).drop("rank")
    return sentences.join(chosen, ["file", "block_no"], "left_semi")


def holdout_sentences(sentences: DataFrame, eval_size: int, seed: int = 1) -> DataFrame:
    """Tag lines ``kept`` or ``eval``; ``eval_size`` whole sentences go to ``eval``."""
    ranked = rank_by_hash(sentence_keys(sentences), seed, ["file", "block_no"], total="_n")
    part = F.when(F.col("rank") <= F.col("_n") - eval_size, "kept").otherwise("eval")
    return sentences.join(ranked.select("file", "block_no", part.alias("part")), ["file", "block_no"])


def cap_examples(df: DataFrame, key: Sequence[str], max_rows: int, seed: int = 1) -> DataFrame:
    """At most ``max_rows`` rows, drawn by the seeded shuffle."""
    return rank_by_hash(df, seed, key, keep=max_rows).drop("rank")


def head_per_language(df: DataFrame, max_rows: int, order: Sequence[str], by: str = "lang") -> DataFrame:
    return head_per_group(df, max_rows, by, order)


def shard_of(row_no: Column, total: Column, shards: int) -> Column:
    """1-based shard of a row: the first shards hold n div k rows, the last n mod k hold one more."""
    small = F.floor(total / F.lit(shards))
    few = (F.lit(shards) - total % F.lit(shards)) * small
    index = row_no - 1
    early = F.floor(index / F.greatest(small, F.lit(1)))
    late = F.lit(shards) - total % F.lit(shards) + F.floor((index - few) / (small + 1))
    return F.when(index < few, early).otherwise(late).cast("long") + 1


def make_shards(df: DataFrame, shards: int, order: Sequence[str], shuffle_seed: int | None = None, position: str | None = None) -> DataFrame:
    """Contiguous shards of the corpus in ``order``, or of its seeded shuffle; ``position`` names the column of that order."""
    if shuffle_seed is None:
        numbered = number_rows(df, order, name="_rank", total="_n")
    else:
        numbered = rank_by_hash(df, shuffle_seed, order, name="_rank", total="_n")
    return _placed(numbered.withColumn("shard_id", shard_of(F.col("_rank"), F.col("_n"), shards)), position)
