"""Corpus merging, deduplication and line filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import letters, normal_key, words


def merge_corpora(*corpora: DataFrame) -> DataFrame:
    """Bag union; each row keeps its own position, so the order of the parts can be restored."""
    return reduce(DataFrame.unionByName, corpora)


def dedup_exact(lines: DataFrame) -> DataFrame:
    """Distinct lines. Only the line column is shuffled, after a map-side combine."""
    return lines.select("line").distinct()


def dedup_normalized(lines: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first line (by ``order``) among lines that agree on lowercase letters.

    Rows group on a 16-byte digest of the key, not the key text, and each task keeps one candidate
    per key before the shuffle, so a line copied into a third of the corpus costs one row per task.
    """
    others = [c for c in lines.columns if c not in order]
    first = F.min(F.struct(*order, *others)).alias("first")
    return lines.groupBy(F.unhex(F.md5(normal_key(F.col("line")))).alias("key")).agg(first).select("first.*").select(*lines.columns)


def word_count_between(line: Column, low: int = 2, high: int = 100) -> Column:
    return F.size(words(line)).between(low, high)


def average_word_length_between(line: Column, low: float = 2, high: float = 16) -> Column:
    parts = words(line)
    return (F.char_length(F.array_join(parts, "")) / F.size(parts)).between(low, high)


def longest_word_below(line: Column, threshold: int = 32) -> Column:
    return F.array_max(F.transform(words(line), F.char_length)) < threshold


def alphabet_ratio_at_least(line: Column, threshold: float = 0.5) -> Column:
    return F.char_length(letters(line)) / F.char_length(line) >= threshold


def filter_word_count(lines: DataFrame, low: int = 2, high: int = 100) -> DataFrame:
    return lines.filter(word_count_between(F.col("line"), low, high))


def filter_avg_word_length(lines: DataFrame, low: float = 2, high: float = 16) -> DataFrame:
    return lines.filter(average_word_length_between(F.col("line"), low, high))


def filter_long_word(lines: DataFrame, threshold: int = 32) -> DataFrame:
    return lines.filter(longest_word_below(F.col("line"), threshold))


def filter_alphabet_ratio(lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    return lines.filter(alphabet_ratio_at_least(F.col("line"), threshold))


def filter_quality(lines: DataFrame, max_words: int = 100, max_average: float = 16, long_word: int = 32,
                   alphabet: float = 0.5) -> DataFrame:
    """The four line filters in one narrow stage."""
    kept = filter_word_count(lines, 2, max_words)
    kept = filter_avg_word_length(kept, 2, max_average)
    return filter_alphabet_ratio(filter_long_word(kept, long_word), alphabet)


# Punctuation that loses the space before it, and that loses the space behind it.
CLOSING = r" ([,.;:?!\)\]»“])"
OPENING = r"([\(\[«„]) "


def detokenize_punctuation(lines: DataFrame) -> DataFrame:
    """Drop the space before closing and after opening punctuation."""
    closed = F.regexp_replace("line", CLOSING, "$1")
    return lines.withColumn("line", F.regexp_replace(closed, OPENING, "$1"))
