"""Language identification by character trigrams, and the inverse confidence filter built on it.

A multinomial naive Bayes model over hashed trigrams: counting is one combining aggregation, and
scoring keeps every line in its task. The lines of a batch are one array of code points: buckets are computed for all of
them together, weights are gathered once and summed by segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # log-likelihood by bucket and language
    priors: np.ndarray


_SLICE = 1 << 17  # characters whose weights a task gathers at a time


def trigram_slices(lines: pd.Series, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first line, trigrams of each line, buckets of all their trigrams) of runs of lines of about ``_SLICE`` characters.

    Trigrams overlap; a line is padded with one space on each side, so it has as many as characters.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _SLICE, "right")))
        text = f" {'  '.join(lines.iloc[first:last])} "
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        own = np.arange(int(ends[last - 1] - done)) + np.repeat(2 * np.arange(last - first), sizes[first:last])  # the first characters of trigrams that end in their own line
        yield first, sizes[first:last], (points[own] * 961 + points[own + 1] * 31 + points[own + 2]) % buckets
        first = last


def line_scores(lines: pd.Series, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each line's trigrams, by language."""
    out = np.zeros((len(lines), weights.shape[1]))
    for first, sizes, found in trigram_slices(lines, len(weights)):
        if len(sizes) == 1:  # of any length
            out[first] = np.bincount(found, minlength=len(weights)) @ weights
        elif len(found):
            some = np.flatnonzero(sizes)
            out[first + some] = np.add.reduceat(weights[found], (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def fit_language_id(lines: DataFrame, buckets: int = 1 << 14) -> LanguageModel:
    """Count trigrams per language; a task emits one count vector per language, lines in slot 0.

    Rows without a language or a line are not counted.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            codes, names = pd.factorize(batch["lang"])
            for name, rows in zip(names, np.bincount(codes, minlength=len(names))):
                totals.setdefault(name, np.zeros(buckets + 1))[0] += rows
            for first, sizes, found in trigram_slices(batch["line"], buckets):
                owner = np.repeat(codes[first:first + len(sizes)], sizes)
                for code in np.unique(owner):
                    totals[names[code]][1:] += np.bincount(found[owner == code], minlength=buckets)
        if totals:
            yield pd.DataFrame({"lang": list(totals), "seen": list(totals.values())})

    partial = lines.select("lang", "line").dropna().mapInPandas(count, "lang string, seen array<double>")
    summed = partial.groupBy("lang").agg(Summarizer.sum(array_to_vector("seen")).alias("seen")).collect()  # one row per language
    by_lang = {r.lang: r.seen.toArray() for r in summed}
    languages = sorted(by_lang)
    documents = np.array([by_lang[lang][0] for lang in languages])
    table = np.stack([by_lang[lang][1:] for lang in languages], axis=1)
    smoothed = table + 1.0
    return LanguageModel(languages, np.log(smoothed / smoothed.sum(axis=0)), np.log(documents / documents.sum()))


def identify_language(lines: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``(predicted, confidence)`` to each line; confidence is the posterior probability. A null line counts as empty."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("predicted", T.StringType()), T.StructField("confidence", T.DoubleType())])

    @F.pandas_udf(schema)
    def identify(line: pd.Series) -> pd.DataFrame:
        m = shared.value
        scores = m.priors + line_scores(line.fillna(""), m.weights)
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        return pd.DataFrame({"predicted": [m.languages[i] for i in best], "confidence": odds.max(axis=1) / odds.sum(axis=1)})

    return lines.withColumn("_id", identify.asNondeterministic()("line")).select(*lines.columns, "_id.predicted", "_id.confidence")


def filter_language_id(lines: DataFrame, model: LanguageModel, language: str = "en", threshold: float = 0.9) -> DataFrame:
    """Inverse filter: drop the lines identified as ``language`` with at least ``threshold``."""
    scored = identify_language(lines, model)
    return scored.filter(~((F.col("predicted") == language) & (F.col("confidence") >= threshold))).drop("predicted", "confidence")
