"""Language identification by fusing evidence: text, declared language, address suffix and host.

Text likelihoods come from a naive Bayes model over hashed byte trigrams, fitted on a bounded sample of distinct texts of each
language that enough texts declare. No text model can speak for or against a rarer language, so there the declaration decides. The other three kinds of evidence are counted over all rows, by the language that
the text alone suggests: how often rows of a language declare each value, and how the languages of a suffix, a domain and a
host are spread. A host's prior is smoothed towards that of its domain, this towards its suffix and that towards all
rows, so a small host says little and a large one much; a row's own vote is left out of its host's counts. The suffix counts once, as the level
of this prior that all hosts under it share: it has no factor of its own beside it.
All tables are grouped aggregates of (value or host, language) rows; the texts are read once and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.storage import without, written
from lexmesh.llm.words import utf8

TRAIN_ROWS = 4000
LEAST_RECORDS = 20
BUCKETS = 1 << 15
TEXT_WEIGHT = 0.25
SMOOTHING = 5.0
UNKNOWN = "und"
UNKNOWN_SHARE = 1e-3
LEAST_POSTERIOR = 0.5

_SLICE = 1 << 20
_FOLD = np.full(256, 32, np.uint32)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts at each byte, and whether it holds a letter."""
    b = _FOLD[data]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32), code != 0x202020


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bytes) in slices of bounded length; slices of one text overlap by two bytes, so no trigram is lost."""
    data, offsets = utf8(column)
    for row in range(len(offsets) - 1):
        low, high = int(offsets[row]), int(offsets[row + 1])
        for at in range(low, max(low + 1, high - 2), _SLICE):
            yield row, data[at:min(high, at + _SLICE + 2)]


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for row, data in _pieces(batch.column(1)):
            if len(data) >= 3:
                buckets, real = _trigrams(data)
                counts.setdefault(labels[row], np.zeros(BUCKETS, np.int64))
                counts[labels[row]] += np.bincount(buckets[real], minlength=BUCKETS)
    for label, found in counts.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([label] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(found[at])})


class TextModel:
    """Log probabilities of trigram buckets per language; the last language is the unknown one, for which all are alike."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smoothed = counts + 0.5
        weights = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
        self.weights = np.vstack([weights, np.full((1, BUCKETS), -math.log(BUCKETS))])

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods, trigrams) of each row. Rows without a letter have none."""
        total, count = np.zeros((len(column), len(self.languages))), np.zeros(len(column), np.int64)
        for row, data in _pieces(column):
            if len(data) >= 3:
                buckets, real = _trigrams(data)
                buckets = buckets[real]
                count[row] += len(buckets)
                seen = np.bincount(buckets, minlength=BUCKETS) if len(buckets) > BUCKETS else None
                total[row] += self.weights @ seen if seen is not None else self.weights[:, buckets].sum(axis=1)
        return total, count


def training_texts(labelled: DataFrame, per_language: int) -> tuple[list[str], DataFrame]:
    """Languages with ``LEAST_RECORDS`` distinct texts or more among all rows, and about ``per_language`` distinct texts (declared, text) of each.

    Copies count once: what is counted and drawn are hashes of (language, text). Hashes are evenly spread, so the texts whose hash lies in the
    first ``per_language`` / n of the range are a sample of a language's n texts; a language with fewer gives all.
    """
    spark = labelled.sparkSession
    rows = labelled.withColumn("h", F.xxhash64("declared", "text"))
    sizes = rows.select("declared", "h").distinct().groupBy("declared").count().filter(F.col("count") >= min(LEAST_RECORDS, per_language)).collect()  # one row per language
    names = sorted(r["declared"] for r in sizes)
    # the last hash drawn, in steps of the whole range of 64 bits
    last = [(r["declared"], min((1 << 63) - 1, -(1 << 63) + (per_language << 64) // r["count"])) for r in sizes]
    bounds = F.broadcast(spark.createDataFrame(last, "name string, last long"))
    drawn = rows.join(bounds, (F.col("declared") == F.col("name")) & (F.col("h") <= F.col("last")))
    return names, drawn.select("declared", "h", "text").dropDuplicates(["declared", "h"]).select("declared", "text")


def fit(records: DataFrame, train_rows: int = TRAIN_ROWS) -> TextModel:
    """Fit on about ``train_rows`` distinct texts of each language that enough of all rows declare."""
    labelled = records.filter(F.col("text").isNotNull() & (F.col("declared") != UNKNOWN)).select("declared", "text")
    common, sample = training_texts(labelled, train_rows)
    counts = np.zeros((len(common), BUCKETS))
    if common:
        found = sample.mapInArrow(_training_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS at most
        counts[pc.index_in(found["lang"], pa.array(common)).to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return TextModel(common, counts)


def _scored(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts = model_of.value.score(batch.column("text"))
            others = [n for n in batch.schema.names if n != "text"]
            arrays = [batch.column(n) for n in others]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(scores), pa.list_(pa.float64())), pa.array(counts)], [*others, "scores", "trigrams"])
    return run


def primary(tag: Column) -> Column:
    """Primary subtag of a language tag, lower-cased; null for anything else."""
    found = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,8})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _argmax(values: Column) -> Column:
    """Position of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def _votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best, votes: a row per key and language that occurs with it."""
    return rows.groupBy(*keys, "best").agg(F.sum("votes").alias("votes"))


def _vectors(votes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, n: the votes of each key as an array over all languages."""
    held = votes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "votes"))).alias("m"))  # as many as there are languages
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("n"))


def _by_language(votes: DataFrame, size: int) -> list[float]:
    found = {r["best"]: r["votes"] for r in _votes(votes, []).collect()}  # a row per language
    return [found.get(i, 0.0) for i in range(size)]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _smoothed(counts: Column, towards: Column) -> Column:
    total = _total(counts)
    return F.zip_with(counts, towards, lambda n, p: (n + SMOOTHING * p) / (total + SMOOTHING))


def _likelihoods(rows: DataFrame, column: str, size: int) -> DataFrame:
    """(value, log P(value | language) array), smoothed by one more row spread over the values."""
    votes = written(_votes(rows.filter(F.col(column).isNotNull()), [column]), f"{column}-votes")
    values = votes.select(column).distinct().count()
    whole = F.array(*[F.lit(x) for x in _by_language(votes, size)])
    return _vectors(votes, [column], size).select(
        column, F.zip_with("n", whole, lambda n, all_: F.log((n + 1.0 / max(values, 1)) / (all_ + 1.0))).alias(f"{column}_log"))


def identify(records: DataFrame, keys: list[str], train_rows: int = TRAIN_ROWS, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """Per row the ``keys`` and lang, posterior, text_lang, keep.

    ``records`` has the keys and text, markup (declared language tag), address (URL) and host; each of the last four may be null, which is
    no evidence. The host is taken from the address where it is null. ``lang`` is the most probable language, the
    first in alphabetical order of equals, or ``und``; ``keep`` is false for texts without a letter, for ``und`` and below
    ``least_posterior``. A row that declares a language with too few distinct texts for a text model (``LEAST_RECORDS``) and has a letter gets
    that language with a posterior of 1; ``text_lang`` still says what the text alone suggests. Repeated rows are each returned and each
    counted. Rows that declare nothing are ``und`` where no language has a text model. Other columns are dropped.
    """
    spark = records.sparkSession
    address = F.col("address").cast("string")
    host = F.coalesce(F.col("host").cast("string"), host_of(address))
    rows = records.select(*keys, F.col("text").cast("string").alias("text"), primary(F.col("markup").cast("string")).alias("declared"),
                          F.when(host_of(address) != "", F.regexp_extract(host_of(address), r"([^.]+)$", 1)).alias("suffix"),
                          F.when(host_of(address) != "", F.regexp_extract(host_of(address), r"([^.]+\.[^.]+)$", 1)).alias("domain"), F.when(host != "", host).alias("host"))
    model = fit(rows, train_rows)
    size = len(model.languages)
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    fields = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", scores array<double>, trigrams long"
    # one more logarithm of prior for the unknown language, so that a few odd letters do not make a text unknown
    prior = F.array(*[F.lit(math.log(UNKNOWN_SHARE if n == UNKNOWN else 1.0)) for n in model.languages])
    scored = rows.mapInArrow(_scored(shared), schema).withColumn("scores", F.transform("scores", lambda s: s * TEXT_WEIGHT))
    scored = written(scored.withColumn("best", F.when(F.col("trigrams") > 0, _argmax(F.zip_with("scores", prior, lambda a, b: a + b)))), "language-scores")
    voting = scored.filter("best is not null").withColumn("votes", F.lit(1.0))

    whole = _by_language(voting, size)
    everywhere = F.array(*[F.lit((n + 1.0) / (sum(whole) + size)) for n in whole])
    levels = ["host", "domain", "suffix"]
    votes = written(_votes(voting.filter("host is not null"), levels), "host-votes")
    under = lambda keys: _vectors(_votes(votes.filter(F.col(keys[0]).isNotNull()), keys), keys, size)
    suffixes = under(["suffix"]).select("suffix", _smoothed(F.col("n"), everywhere).alias("suffix_prior"))
    domains = under(["domain", "suffix"]).join(suffixes, "suffix").select("domain", "suffix", _smoothed(F.col("n"), F.col("suffix_prior")).alias("domain_prior"))
    priors = _vectors(votes, levels, size).join(domains, ["domain", "suffix"], "left").join(suffixes, "suffix", "left").select(
        *levels, "n", F.coalesce("domain_prior", "suffix_prior", everywhere).alias("towards"))
    priors = written(priors.select(*[F.col(c).alias(f"_{c}") for c in levels], "n", "towards"), "host-priors")
    declared = written(_likelihoods(voting, "declared", size), "declared-likelihoods")

    same = (F.col("host") == F.col("_host")) & F.col("domain").eqNullSafe(F.col("_domain")) & F.col("suffix").eqNullSafe(F.col("_suffix"))
    joined = scored.join(priors, same, "left").join(declared, "declared", "left")
    own = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == F.col("best"), 1.0).otherwise(0.0))
    others = F.zip_with("n", own, lambda n, o: n - o)
    host_prior = F.coalesce(F.when(F.col("n").isNotNull(), _smoothed(others, F.col("towards"))), everywhere)
    none = F.array(*[F.lit(0.0)] * size)
    evidence = [F.col("scores"), F.transform(host_prior, lambda p: F.log(p)), F.coalesce("declared_log", none), prior]
    fused = evidence[0]
    for more in evidence[1:]:
        fused = F.zip_with(fused, more, lambda a, b: a + b)
    names = F.array(*[F.lit(n) for n in model.languages])
    told = joined.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    weight = _total(F.transform("fused", lambda x: F.exp(x - F.col("top"))))
    lang = F.get(names, _argmax(F.col("fused")))
    unlearnt = F.col("declared").isNotNull() & ~F.array_contains(names, F.col("declared"))
    lang, posterior = F.when(unlearnt, F.col("declared")).otherwise(lang), F.when(unlearnt, 1.0).otherwise(1.0 / weight)
    out = told.select(*keys, F.when(F.col("trigrams") > 0, lang).otherwise(UNKNOWN).alias("lang"), F.when(F.col("trigrams") > 0, posterior).otherwise(0.0).alias("posterior"),
                      F.coalesce(F.get(names, F.col("best")), F.lit(UNKNOWN)).alias("text_lang"))
    return out.withColumn("keep", (F.col("lang") != UNKNOWN) & (F.col("posterior") >= least_posterior))


def document_records(docs: DataFrame) -> DataFrame:
    """Documents declare ``lang`` and come from ``source``; they have no address."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.xxhash64(text).alias("row"), text.alias("text"),
                       F.col("lang").alias("markup"), F.lit(None).cast("string").alias("address"), F.col("source").alias("host"))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages declare the language of their root element and come from the host of their address; tags are no text."""
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    markup = F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", 1)
    text = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[A-Za-z0-9#]+;?", " ")
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.xxhash64(page).alias("row"), text.alias("text"),
                        F.when(markup != "", markup).alias("markup"), F.col("url").cast("string").alias("address"), F.lit(None).cast("string").alias("host"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, with all their columns."""
    found = identify(document_records(docs), ["doc_id", "row"])
    return without(docs, found.filter(~F.col("keep")), "rejected")
