"""Divergence of sources within a language, by Gustavson's row accumulation.

Counts of (language, source, term) lie in a term-major index: for each term the list of sources that hold it. The
sources of a language against each other are the product of that matrix with its transpose, under a sum that is not
bilinear. A source's row is a dense accumulator with one place per peer. It starts at the zero baseline, which is what
a source without any term would give; for each of its terms the term's list is scattered into the row, and every place
is corrected from the source's zero to its count. So pairs of postings are added up where they meet and never become
rows. Terms are dealt into slices of the index and sources into blocks of rows; accumulators of slices add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm import runs
from lexmesh.llm.storage import written
from lexmesh.session import lookup

_SCALE_STEPS = 3  # a share of 10^9 is taken as three digits three times, so that products stay in 64 bits
_HELD = 1 << 20  # counts a task gathers before it passes them on
_SLICE_POSTINGS = 1 << 20
_BLOCK_SOURCES = 64
_SCATTER = 1 << 20
_TERM = np.zeros(256, bool)
_TERM[ord("A"):ord("Z") + 1] = _TERM[ord("a"):ord("z") + 1] = _TERM[0x80:] = True


class _Counts:
    """Occurrences and documents of (group, term) of a task's texts."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []
        self.long: list[tuple[pa.Array, np.ndarray]] = []  # parts of one text that is longer than a slice
        self.size = 0

    def _put(self, group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> None:
        self.held.append((group, terms, n, docs))
        self.size += len(group)

    def add(self, part: runs.Slice, groups: list[tuple[str, str]]) -> None:
        data = runs.LOWER[part.data]
        first, end, row = runs.words(data, part.starts, _TERM)
        codes, terms = runs.distinct(data, _TERM, first, end)
        if part.continues or part.goes_on:
            self.long.append((terms, np.bincount(codes, minlength=len(terms))))
            if part.goes_on:
                return
            every = pa.concat_arrays([t for t, _ in self.long]).dictionary_encode()
            n = np.zeros(len(every.dictionary), np.int64)
            np.add.at(n, every.indices.to_numpy(), np.concatenate([c for _, c in self.long]))
            group = self.groups.setdefault(groups[part.row], len(self.groups))
            self._put(np.full(len(n), group), every.dictionary, n, np.ones(len(n), np.int64))
            self.long = []
        elif len(first):
            number = np.array([self.groups.setdefault(x, len(self.groups)) for x in groups[part.row:part.row + len(part.starts)]], np.int64)
            inverse, in_row = pd.factorize(row * len(terms) + codes)
            n = np.bincount(inverse, minlength=len(in_row))
            inverse, pair = pd.factorize(number[in_row // len(terms)] * len(terms) + in_row % len(terms))
            total = np.bincount(inverse, weights=n, minlength=len(pair)).astype(np.int64)
            self._put(pair // len(terms), terms.take(pa.array(pair % len(terms))), total, np.bincount(inverse, minlength=len(pair)))

    def flush(self) -> Iterator[pa.RecordBatch]:
        terms = pa.concat_arrays([t for _, t, _, _ in self.held]).dictionary_encode()
        size = max(1, len(terms.dictionary))
        inverse, pair = pd.factorize(np.concatenate([g for g, _, _, _ in self.held]) * size + terms.indices.to_numpy())
        n, docs = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        np.add.at(n, inverse, np.concatenate([x for _, _, x, _ in self.held]))
        np.add.at(docs, inverse, np.concatenate([x for _, _, _, x in self.held]))
        group = pa.array(pair // size)
        words = terms.dictionary.take(pa.array(pair % size)).cast(pa.binary()).cast(pa.string())
        names = [pa.array([g[i] for g in self.groups], pa.string()).take(group) for i in range(2)]
        table = pa.RecordBatch.from_arrays([*names, words, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
        yield from (table.slice(i, 1 << 16) for i in range(0, table.num_rows, 1 << 16))
        self.held, self.size = [], 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for part in runs.slices(batch.column(2), _TERM):
            counts.add(part, groups)
            if counts.size >= _HELD:
                yield from counts.flush()
    if counts.size:
        yield from counts.flush()


def _share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / whole), exactly; ``whole`` under 9 * 10^15 and at least count + 1."""
    rest, digits = count + 1, np.zeros(np.broadcast(count, whole).shape, np.int64)
    for _ in range(_SCALE_STEPS):
        rest = rest * 1000
        digits = digits * 1000 + rest // whole
        rest = rest % whole
    return digits + 1


def _share_column(count: Column, whole: Column) -> Column:
    rest, digits = count + F.lit(1), F.lit(0).cast("long")
    for _ in range(_SCALE_STEPS):
        rest = rest * F.lit(1000)
        digits = digits * F.lit(1000) + F.call_function("div", rest, whole)
        rest = rest % whole
    return digits + F.lit(1)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _scattered(acc: np.ndarray, own: np.ndarray, terms: np.ndarray, bounds: np.ndarray, peer: np.ndarray, share: np.ndarray, zero: np.ndarray, mine: int) -> None:
    """Into one source's row: its terms' lists. Every peer first counts as without the term, then the peers that hold it are corrected."""
    values, often = np.unique(own, return_counts=True)
    step = max(1, _SCATTER // len(zero))
    for i in range(0, len(values), step):
        acc += (often[i:i + step, None] * (_apart(values[i:i + step, None], zero) - _apart(mine, zero))).sum(axis=0)
    sizes = np.diff(bounds)[terms]
    ends = np.cumsum(sizes)
    low = 0
    while low < len(terms):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _SCATTER, side="right")))
        count = sizes[low:high]
        at = np.repeat(bounds[terms[low:high]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        h, q, p = peer[at], share[at], np.repeat(own[low:high], count)
        np.add.at(acc, h, _apart(p, q) - _apart(mine, q) - _apart(p, zero[h]) + _apart(mine, zero[h]))
        low = high


def _rows(index: pa.Table, sources: pa.Table) -> pa.Table:
    """Accumulators of a block of sources over one slice; slice -1 holds the baseline (counts of each peer with their frequencies)."""
    sources = sources.sort_by("g")
    lang, number, block = (sources.column(c)[0].as_py() for c in ("lang", "slice", "block"))
    total, v = sources.column("total").to_numpy(), sources.column("v")[0].as_py()
    low, high = block * _BLOCK_SOURCES, min((block + 1) * _BLOCK_SOURCES, len(total))
    acc = np.zeros((high - low, len(total)), np.int64)
    if v:
        whole = total + v
        zero = _share(np.zeros(1, np.int64), whole)
        lists = index.column("postings").combine_chunks()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        peer, n = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        peer, share = peer[bounds[0]:bounds[-1]], _share(n, whole[peer])[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        if number < 0:
            often = index.column("m").to_numpy()
            for g in range(low, high):
                row = acc[g - low]
                held = np.zeros(len(total), np.int64)
                np.add.at(held, peer, often)
                np.add.at(row, peer, often * _apart(zero[g], share))
                row += (v - held) * _apart(zero[g], zero)
        else:
            term = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order = np.argsort(peer, kind="stable")
            cuts = np.searchsorted(peer[order], np.arange(low, high + 1))
            for g in range(low, high):
                own = order[cuts[g - low]:cuts[g - low + 1]]
                if len(own):
                    _scattered(acc[g - low], share[own], term[own], bounds, peer, share, zero, int(zero[g]))
    g, h = np.divmod(np.arange(acc.size), len(total))
    other = g + low != h
    return pa.table({"lang": pa.array([lang] * int(other.sum()), pa.string()), "g": pa.array((g + low)[other]), "h": pa.array(h[other]), "value": pa.array(acc.ravel()[other])})


def term_index(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(the sources of each language with number g, kept occurrences ``total`` and kept terms ``v`` of the language; lang, term, postings of (g, n))."""
    names = docs.select("lang", "source").distinct()
    names = written(names.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "sources")
    counts = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # one shuffle by term serves both sums; tasks have added up their own texts before
    dealt = lookup(counts, names, ["lang", "source"]).select("lang", "term", "g", "n", "docs").repartition("lang", "term")
    each = dealt.groupBy("lang", "term", "g").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("g", "n")).alias("postings"))
    index = written(index.filter(F.col("docs") >= least_docs).select("lang", "term", "postings"), "term-index")
    totals = index.select("lang", F.explode("postings").alias("x")).groupBy("lang", F.col("x.g").alias("g")).agg(F.sum("x.n").alias("total"))
    kept = index.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sources = names.join(totals, ["lang", "g"], "left").join(kept, "lang", "left").fillna(0, ["total", "v"])
    return written(sources, "source-totals"), index


def _pairs(sources: DataFrame, index: DataFrame) -> DataFrame:
    slices = index.groupBy("lang").agg(F.ceil(F.sum(F.size("postings")) / _SLICE_POSTINGS).cast("long").alias("slices"))
    blocks = F.transform("postings", lambda x: F.call_function("div", x["g"], F.lit(_BLOCK_SOURCES)))
    lists = lookup(index, slices, ["lang"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"), F.explode(F.array_distinct(blocks)).alias("block"), F.lit(1).cast("long").alias("m"), "postings")
    sizes = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    every = sizes.join(slices, "lang", "left").select(
        "lang", F.explode(F.sequence(F.lit(-1).cast("long"), F.coalesce("slices", F.lit(0)) - 1)).alias("slice"),
        F.call_function("div", F.col("n") - 1, F.lit(_BLOCK_SOURCES)).alias("last"))
    every = every.select("lang", "slice", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    counts = index.select("lang", F.explode("postings").alias("x")).groupBy("lang", "x.g", "x.n").agg(F.count(F.lit(1)).alias("m"))
    base = counts.join(every.filter("slice < 0"), "lang").select("lang", "slice", "block", "m", F.array(F.struct("g", "n")).alias("postings"))
    peers = sources.join(every, "lang").select("lang", "slice", "block", "g", "total", "v")
    key = ["lang", "slice", "block"]
    parts = lists.unionByName(base).groupBy(*key).cogroup(peers.groupBy(*key)).applyInArrow(_rows, "lang string, g long, h long, value long")
    return parts.groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))


def source_divergence(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """Per source of a language: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in at least
    ``least_docs`` of its documents (V terms). A source gives a kept term of ``count`` occurrences
    p = 1 + floor(10^9 * (count + 1) / (N + V)), N its occurrences of kept terms, and two such numbers lie
    floor((p - q)^2 / q) apart. Part ``pair`` has every other source of the language with the sum over all V terms; part
    ``term`` the first ``top_terms`` terms of the source whose p exceeds the language's q. Order: value, then item.
    Null texts, languages and sources are ''. Rows that repeat an id, or lack one, are documents of their own; a source
    without terms takes part; a language without kept terms has pairs of value 0; an empty table gives no rows. Texts of
    any length are read in slices and count as one document. Other columns are not read, whatever their names.
    """
    named = [(lang_column, "lang"), (source_column, "source"), (text_column, "text")]
    sources, index = term_index(docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in named)), least_docs)
    names = sources.select("lang", "g", "source")
    pairs = lookup(lookup(_pairs(sources, index), names, ["lang", "g"]), names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    whole = sources.groupBy("lang").agg((F.sum("total") + F.max("v")).alias("whole"))
    held = index.select("lang", "term", F.aggregate("postings", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("all"), F.explode("postings").alias("x"))
    held = lookup(lookup(held.select("lang", "term", "all", "x.g", "x.n"), sources, ["lang", "g"]), whole, ["lang"])
    p, q = _share_column(F.col("n"), F.col("total") + F.col("v")), _share_column(F.col("all"), F.col("whole"))
    above = held.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    above = above.withColumn("value", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")))
    above = above.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(above.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
