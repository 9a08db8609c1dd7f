"""Normalisation, word counts, alphabets and vocabulary assembly."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.functions.text import WORD_INITIAL, words
from lexmesh.session import cut_lineage, lookup

# Reserved pieces in id order, for the unigram and for the BPE vocabulary.
UNIGRAM_RESERVED = ("<s>", "<pad>", "</s>", "<unk>", "<mask>")
BPE_RESERVED = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")


def _fold(text: str) -> str:
    decomposed = unicodedata.normalize("NFD", text).lower()
    return "".join(c for c in unicodedata.normalize("NFD", decomposed) if not unicodedata.category(c).startswith("M"))


@F.pandas_udf(T.StringType())
def _fold_non_ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _fold(t))


def normalize_nfd_lower_strip(text: Column) -> Column:
    """NFD, lowercase, accents removed. ASCII rows stay in the JVM; the rest goes through Arrow."""
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_only, F.lower(text)).otherwise(_fold_non_ascii(F.when(~ascii_only, text)))


def pretokenize(line: Column) -> Column:
    """Runs of word characters, or runs of punctuation."""
    return F.regexp_extract_all(line, F.lit(r"(?U)(\w+|[^\w\s]+)"), F.lit(1))


def word_frequencies(tokens: DataFrame, word: str = "word") -> DataFrame:
    return tokens.groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def line_words(lines: DataFrame) -> DataFrame:
    """Whitespace words, one row each."""
    return lines.select("lang", F.explode(words(F.col("line"))).alias("word"))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def alphabet_by_coverage(frequencies: DataFrame, coverage: float = 0.999) -> DataFrame:
    """Most frequent characters, taken until they cover ``coverage`` of all characters.

    Counted on the word-frequency table. The running sum covers one row per distinct character,
    which Unicode bounds.
    """
    marked = F.concat(F.lit(WORD_INITIAL), F.col("word"))
    counts = frequencies.select(F.explode(characters(marked)).alias("ch"), "n").groupBy("ch").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "ch")
    before = F.coalesce(F.sum("n").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = before / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("ch", "n", F.row_number().over(ranked).cast("long").alias("rank"), share.alias("_share")).filter(
        F.col("_share") < coverage).drop("_share")


def restrict_to_alphabet(frequencies: DataFrame, alphabet: DataFrame) -> DataFrame:
    """Words cut at the characters outside the alphabet, which then belong to no piece.

    The alphabet is at most one row per Unicode character and is broadcast as one array.
    """
    kept = alphabet.agg(F.collect_list("ch").alias("kept")).scalar()
    chars = frequencies.select("word", "n", kept.alias("kept"))
    masked = F.array_join(F.transform(characters(F.col("word")), lambda c: F.when(F.array_contains("kept", c), c).otherwise(F.lit("\x00"))), "")
    parts = chars.select(F.explode(F.split(masked, "\x00")).alias("word"), "n")
    return parts.filter(F.col("word") != "").groupBy("word").agg(F.sum("n").alias("n"))


def largest(df: DataFrame, size: int, score: str, tie: str) -> DataFrame:
    """The ``size`` rows with the largest ``score``, ties by ascending ``tie``.

    A histogram of the score's magnitude first drops the rows that cannot be among them, so the
    final top-k does not receive ``size`` rows from every task. The table is checkpointed, because
    it is usually an aggregate of the whole corpus and read twice here.
    """
    value = F.col(score).cast("double")
    binned = cut_lineage(df).withColumn("_bin", F.floor(F.signum(value) * F.log1p(F.abs(value)) * 64).cast("long"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))  # a few thousand bins cover all doubles that occur
    reached = bins.select("_bin", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above")).filter(F.col("_above") < size)
    kept = binned.filter(F.col("_bin") >= reached.agg(F.min("_bin")).scalar()).drop("_bin")
    return kept.orderBy(F.desc(score), tie).limit(size)


def top_ranked(df: DataFrame, size: int, score: str, tie: str, name: str = "rank") -> DataFrame:
    """``largest`` numbered from 1: a vocabulary cut, bounded by its size."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), tie)
    return largest(df, size, score, tie).withColumn(name, F.row_number().over(order).cast("long"))


def assemble_vocab(pieces: DataFrame, size: int, reserved: Sequence[str] = UNIGRAM_RESERVED) -> DataFrame:
    """Reserved pieces on the first ids, then pieces by descending score up to ``size`` entries."""
    spark = pieces.sparkSession
    head = spark.createDataFrame([(token, i, True, 0.0) for i, token in enumerate(reserved)],
                                 "token string, id int, is_special boolean, score double")
    learned = pieces.filter(~F.col("piece").isin(*reserved)).select("piece", F.col("score").cast("double").alias("score"))
    ranked = top_ranked(learned, max(size - len(reserved), 0), "score", "piece")
    tail = ranked.select(F.col("piece").alias("token"), (F.col("rank") + (len(reserved) - 1)).cast("int").alias("id"),
                         F.lit(False).alias("is_special"), "score")
    return head.unionByName(tail)


def token_language_counts(tokens: DataFrame, vocab: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Occurrences of every vocabulary token in every language, zeros kept.

    Counts are combined per task before the shuffle; the grid of zeros is the vocabulary with the
    given languages attached to each row, joined to the counts once per vocabulary row. Without
    ``languages`` the grid has all languages that occur in ``tokens``.
    """
    counted = tokens.groupBy("token", "lang").agg(F.count(F.lit(1)).alias("_n"))
    if languages is None:
        named = counted.agg(F.array_sort(F.collect_set("lang"))).scalar()
    else:
        named = F.array(*[F.lit(lang) for lang in languages])
    grid = vocab.select("token", F.explode(named).alias("lang"))
    return grid.join(counted, ["token", "lang"], "left").select("token", "lang", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def attach_ids(tokens: DataFrame, vocab: DataFrame, unknown: int = 3, broadcast_rows: int = 1 << 20) -> DataFrame:
    """Vocabulary ids by equi-join; unknown tokens get the unknown id. A vocabulary of up to ``broadcast_rows`` entries is broadcast."""
    found = lookup(tokens, vocab.select("token", "id"), ["token"], "left", broadcast_rows)
    return found.withColumn("id", F.coalesce("id", F.lit(unknown)))


def add_special_template(first: Column, second: Column | None = None, cls: int = 1, sep: int = 2) -> tuple[Column, Column]:
    """``[CLS] A [SEP]`` or ``[CLS] A [SEP] B [SEP]`` as (ids, type ids); type 1 is B and its [SEP]."""
    ids = F.concat(F.array(F.lit(cls)), first, F.array(F.lit(sep)))
    types = F.array_repeat(F.lit(0), F.size(first) + 2)
    if second is None:
        return ids, types
    return (F.concat(ids, second, F.array(F.lit(sep))), F.concat(types, F.array_repeat(F.lit(1), F.size(second) + 1)))
