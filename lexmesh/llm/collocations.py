"""Phrase collocations by external streams of n-gram counts.

Texts become blocks of word numbers, which are stored. Words that occur often enough are numbered in (language,
word) order, so that comparing numbers compares words, and every block is answered with the numbers of its own.
Each block sorts its windows of four words, and range segments of the prefix order add up the sorted windows of
all blocks: counts of pairs, triples and fours are totals of runs in that one stream. A segment is found from
cumulated word counts, without sampling, so a word that starts a third of all windows is spread over many.

The counts then lie in one stream of all lengths. Sorted by words from the left (prefix order) a phrase comes
before all phrases that begin with it; sorted by words from the right (suffix order) before all that end with it.
Reading a stream once with a stack of open phrases therefore merges the lengths in lockstep: a phrase meets the
counts of its beginnings (or endings) and every beginning meets its extensions. No table is looked up by hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.numbering import number_rows, running
from lexmesh.llm import runs
from lexmesh.llm.storage import written
from lexmesh.session import cut_lineage

LONGEST = 4  # words of a phrase at most; the tables have a column for each
_BLOCK_WORDS = 1 << 20
_SEGMENT_WINDOWS = 1 << 20
_KEYS = [f"w{i + 1}" for i in range(LONGEST)]
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09]] = False
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD &= ~_BREAK


class _Block:
    """Words of a task's texts, as they come; a text that goes on in the next block hands over its last words."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size = 0

    def add(self, part: runs.Slice, langs: list[str]) -> None:
        data = runs.LOWER[part.data]
        first, end, row = runs.words(data, part.starts, _WORD)
        codes, words = runs.distinct(data, _WORD, first, end)
        numbers = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs[part.row:part.row + len(part.starts)]], np.int64)
        pair, different = pd.factorize(numbers[row] * max(1, len(words)) + codes) if len(first) else (codes, np.zeros(0, np.int64))
        # a gap stands before the first word of each piece
        breaks = np.cumsum(_BREAK[data])
        piece = breaks[first] if len(first) else np.zeros(0, np.int64)
        fresh = np.ones(len(first), bool)
        fresh[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
        if len(first) and part.continues:
            fresh[0] = piece[0] > 0
        closing = len(breaks) and breaks[-1] > (piece[-1] if len(first) else 0)
        placed = np.full(len(first) + int(fresh.sum()) + int(closing), -1, np.int64)
        placed[np.arange(len(first)) + np.cumsum(fresh)] = pair
        size = max(1, len(words))
        self.held.append((placed, words.take(pa.array(different % size)) if len(different) else words.slice(0, 0), different // size))
        self.size += len(placed)

    def flush(self, goes_on: bool) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays([w for _, w, _ in self.held]).dictionary_encode()
        size = max(1, len(words.dictionary))
        number, different = pd.factorize(np.concatenate([n for _, _, n in self.held]) * size + words.indices.to_numpy())
        codes, base = [], 0
        for placed, own, _ in self.held:
            codes.append(np.where(placed < 0, -1, np.append(number, 0)[np.where(placed < 0, 0, placed + base)]))
            base += len(own)
        codes = np.concatenate(codes)
        own = len(codes) - (LONGEST - 1 if goes_on else 0)
        texts = words.dictionary.take(pa.array(different % size)).cast(pa.binary()).cast(pa.string())
        langs = pa.array(list(self.langs), pa.string()).take(pa.array(different // size))
        counts = np.bincount(codes[:own][codes[:own] >= 0], minlength=len(different))
        bounds = pa.array([0, len(different)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([runs.squeezed((codes + 1)[None].astype(np.uint32))], pa.binary()), pa.array([own], pa.int64()), pa.ListArray.from_arrays(bounds, langs),
             pa.ListArray.from_arrays(bounds, texts), pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64()))], ["codes", "own", "langs", "words", "counts"])
        self.held, self.size = [], 0
        if goes_on:  # the next block begins with the words that have no whole window here
            tail = codes[own:]
            kept, again = np.unique(tail[tail >= 0], return_inverse=True)
            placed = np.full(len(tail), -1, np.int64)
            placed[tail >= 0] = again
            self.held.append((placed, words.dictionary.take(pa.array(different[kept] % size)), different[kept] // size))
            self.size = len(placed)
        else:
            self.langs = {}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for part in runs.slices(batch.column(1), _WORD):
            block.add(part, langs)
            if block.size >= _BLOCK_WORDS:
                yield from block.flush(part.goes_on)
    if block.size:
        yield from block.flush(False)


def _runs(keys: Sequence[np.ndarray]) -> np.ndarray:
    """Where equal rows of sorted columns begin."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def _ordered(w: np.ndarray) -> np.ndarray:
    high, low = (w[i].astype(np.uint64) << np.uint64(32) | w[i + 1] for i in (0, 2))
    return np.lexsort((low, high))


def _windows(total: int):
    """Sorted different windows of a block with their counts, cut at the bounds of the segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = unpacked(batch.column(0)[row])
                own = batch.column(1)[row].as_py()
                answer = batch.column(2)[row].values
                local, number, start, f = (answer.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                size = max(int(codes.max(initial=0)), int(local.max()) + 1) + 1
                tables = [np.zeros(size, t) for t in (np.uint32, np.float64, np.float64)]
                for table, values in zip(tables, (number, start, f)):
                    table[local + 1] = values
                yield from cut(codes, own, *tables)

    def unpacked(payload: pa.Scalar) -> np.ndarray:
        return runs.unsqueezed(payload.as_py())[0]

    def cut(codes, own, number, start, f):
        followed = np.concatenate((codes, np.zeros(LONGEST, codes.dtype)))
        c = np.stack([followed[i:i + own] for i in range(LONGEST)])
        c[:, number[c[0]] == 0] = 0
        for i in range(1, LONGEST):
            c[i, (c[i - 1] == 0) | (number[c[i]] == 0)] = 0
        c = c[:, c[1] > 0]  # single words are counted already
        if not c.shape[1]:
            return
        w = number[c]
        order = _ordered(w)
        w, c = w[:, order], c[:, order]
        at = _runs(w)
        counts = np.diff(np.append(at, w.shape[1]))
        w, c = w[:, at], c[:, at]
        place = start[c[0]] + f[c[0]] * ((start[c[1]] + f[c[1]] * (start[c[2]] / total)) / total)
        segment = np.floor(place / _SEGMENT_WINDOWS).astype(np.int64)
        edges = np.append(_runs([segment]), len(segment))
        table = np.concatenate((w, counts[None].astype(np.uint32)))
        yield pa.RecordBatch.from_pydict({"segment": pa.array(segment[edges[:-1]], pa.int64()),
                                          "payload": pa.array([runs.squeezed(table[:, a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())})
    return run


def _summed(least: int):
    """Counts of all runs of two to four words of a segment: the frequent ones, and those that may go on in a neighbour."""
    def run(group: pa.Table) -> pa.Table:
        parts = np.concatenate([runs.unsqueezed(p.as_py(), LONGEST + 1) for p in group.column("payload")], axis=1)
        parts = parts[:, _ordered(parts)]
        w, n = parts[:LONGEST], parts[LONGEST].astype(np.int64)
        found = []
        for size in range(2, LONGEST + 1):
            at = _runs(w[:size])
            f = np.add.reduceat(n, at)
            keep = f >= least
            keep[[0, -1]] = True
            keep &= w[size - 1, at] > 0
            at, f = at[keep], f[keep]
            found.append(np.concatenate((w[:size, at].astype(np.int64), np.zeros((LONGEST - size, len(at)), np.int64), f[None])))
        return pa.table([pa.array(x) for x in np.concatenate(found, axis=1)], [*_KEYS, "f"])
    return run


def _depth(key: tuple) -> int:
    return sum(k > 0 for k in key)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of a stream in brief: its first and last phrase, the open phrases at its end, and what extends those open before it."""
    first = last = None
    open_end: dict[int, tuple] = {}
    heads = [0] * LONGEST  # of phrases with the first phrase's beginning of i words: the largest count among one word more
    alive = [True] * LONGEST
    for batch in batches:
        for *key, f in zip(*(batch.column(i).to_pylist() for i in range(LONGEST + 1))):
            depth = _depth(key)
            first = first or key
            for i in range(1, LONGEST):
                alive[i] = alive[i] and key[:i] == first[:i]
                if alive[i] and depth == i + 1:
                    heads[i] = max(heads[i], f)
            open_end = {d: x for d, x in open_end.items() if d < depth and key[:d] == x[0][:d]}
            open_end[depth] = (key, f)
            last = key
    if first:
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [first], "last": [last], "heads": [heads], "alive": [alive],
            "keys": [[open_end[d][0] for d in sorted(open_end)]], "counts": [[open_end[d][1] for d in sorted(open_end)]]})


def _carried(summaries: list) -> tuple[dict[int, dict], dict[int, dict]]:
    """Per partition: the phrases open when it begins (by depth, with their counts), and the largest later extension of those open at its end."""
    before: dict[int, dict] = {}
    stack: dict[int, tuple] = {}
    for s in summaries:
        before[s.part] = {d: x for d, x in stack.items() if x[0][:d] == list(s.first[:d])}
        own = {_depth(k): (list(k), f) for k, f in zip(s.keys, s.counts)}
        stack = {d: x for d, x in before[s.part].items() if d not in own and x[0][:d] == list(s.last[:d])} | own
        top = max(own)
        stack = {d: x for d, x in stack.items() if d <= top}
    after: dict[int, dict] = {}
    later: dict[int, tuple] = {}  # depth: (beginning, largest extension in the partitions behind)
    for s in reversed(summaries):
        after[s.part] = {d: x[1] for d, x in later.items() if x[0] == list(s.last[:d])}
        fresh = {}
        for d in range(1, LONGEST):
            begins = list(s.first[:d])
            most = s.heads[d]
            if s.alive[d] and d in later and later[d][0] == begins:
                most = max(most, later[d][1])
            fresh[d] = (begins, most)
        later = fresh
    return before, after


def _lockstep(before: dict[int, dict], after: dict[int, dict], names: list[str]):
    """Each phrase with the counts of its beginnings of one to three words (0: none) and the largest count of an extension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # an open phrase: its words, depth, count, largest extension, and its row (None: another partition's)
        stack = [[key, d, f, 0, None] for d, (key, f) in sorted(before.get(part, {}).items())]
        done: list[tuple] = []

        def closed(x: list) -> None:
            if x[4] is not None:
                done.append((*x[4], x[3]))

        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, f = list(row[:LONGEST]), row[LONGEST]
                depth = _depth(key)
                while stack and (stack[-1][1] >= depth or stack[-1][0][:stack[-1][1]] != key[:stack[-1][1]]):
                    closed(stack.pop())
                if stack and stack[-1][1] == depth - 1:
                    stack[-1][3] = max(stack[-1][3], f)
                counts = [0] * (LONGEST - 1)
                for x in stack:
                    counts[x[1] - 1] = x[2]
                stack.append([key, depth, f, 0, (*row, *counts)])
            if done:
                yield out(done, schema)
                done = []
        for x in stack:
            x[3] = max(x[3], after.get(part, {}).get(x[1], 0))
            closed(x)
        if done:
            yield out(done, schema)

    def out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [*schema.types, *[pa.int64()] * LONGEST]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    return run


def merged_stream(counts: DataFrame, prefix: str) -> DataFrame:
    """``counts`` (four word columns padded with 0, a count, further columns), sorted by its first four columns and read in lockstep.

    Adds ``{prefix}1`` to ``{prefix}3``, the counts of the phrase's beginnings of so many words in that order, and
    ``{prefix}_longer``, the largest count among phrases that continue it by a word. All beginnings must be present.
    What neighbouring partitions share, at most three open phrases, is settled from one summary row a partition.
    """
    keys = counts.columns[:LONGEST]
    stream = cut_lineage(counts.repartitionByRange(*keys).sortWithinPartitions(*keys))
    brief = "part int, first array<long>, last array<long>, heads array<long>, alive array<boolean>, keys array<array<long>>, counts array<long>"
    summaries = stream.select(stream.columns[:LONGEST + 1]).mapInArrow(_summary, brief).collect()
    before, after = _carried(sorted(summaries, key=lambda s: s.part))
    added = [*(f"{prefix}{i}" for i in range(1, LONGEST)), f"{prefix}_longer"]
    schema = ", ".join([*(f"{c} long" for c in stream.columns), *(f"{c} long" for c in added)])
    return stream.mapInArrow(_lockstep(before, after, [*stream.columns, *added]), schema)


def phrase_counts(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words occurring ``least`` times: lang, word, id, f; phrases of two to four words occurring so often; words per language)."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("code", "x")).select(
        "block", "code", F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = written(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    sizes = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    often = number_rows(totals.filter(F.col("f") >= least), ["lang", "word"], name="id")
    often = written(running(often, [], "id", F.col("f"), "start", inclusive=False), "frequent-words")
    last, total = often.agg(F.max("id"), F.sum("f")).first()
    if (last or 0) >= 1 << 32:
        raise ValueError("more than 2^32 frequent words: numbers of words are 32 bits wide")
    found = each.join(often, ["lang", "word"]).groupBy("block").agg(
        F.collect_list(F.struct("code", "id", F.coalesce("start", F.lit(0)).alias("start"), often["f"].alias("f"))).alias("answer"))
    windows = blocks.select("block", "codes", "own").join(found, "block").select("codes", "own", "answer").mapInArrow(_windows(total or 1), "segment long, payload binary")
    schema = ", ".join(f"{c} long" for c in [*_KEYS, "f"])
    parts = windows.groupBy("segment").applyInArrow(_summed(least), schema)
    counts = parts.groupBy(*_KEYS).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return often, counts, sizes


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at space and tab. ``a`` is the phrase's count, and
    of all cuts into two parts (counts ``l`` and ``r``) that of the lowest floor(2000000 * a / (l + r)) counts, the
    earliest of equals. Phrases of fewer than ``least`` occurrences are no candidates; a candidate that lies in a longer
    one with at least ``inside`` per cent of its count is dropped. Null texts are empty, a null language is ``und``;
    repeated rows count again; texts of any length are cut into blocks that share their border words. Languages without
    a candidate have no rows; an empty table gives none. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    blocks = rows.mapInArrow(_blocks, "codes binary, own long, langs array<string>, words array<string>, counts array<long>")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "word-blocks")
    often, counts, sizes = phrase_counts(blocks, least)
    every = counts.unionByName(often.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(k) for k in _KEYS[1:]), "f"))
    left = merged_stream(every, "l")
    backwards = F.reverse(F.filter(F.array(*_KEYS), lambda x: x > 0))
    turned = left.withColumn("_back", backwards).select(
        *(F.coalesce(F.get("_back", F.lit(i)), F.lit(0)).alias(f"s{i + 1}") for i in range(LONGEST)), "f", *_KEYS, "l1", "l2", "l3", "l_longer")
    both = merged_stream(turned, "r").filter("w2 > 0")
    words = sum(((F.col(k) > 0).cast("int") for k in _KEYS), F.lit(0))
    wide = F.col("f").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    options = []
    for k in range(1, LONGEST):  # the rest behind a cut after k words has words - k of them
        rest = F.coalesce(*(F.when(words - k == i, F.col(f"r{i}")) for i in range(1, LONGEST)))
        score = F.call_function("div", wide, (F.col(f"l{k}") + rest).cast("decimal(20,0)"))
        options.append(F.when(words > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), rest.alias("r"))))
    best = F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull()))
    kept = both.filter(100 * F.greatest("l_longer", "r_longer") < inside * F.col("f")).select(*_KEYS, F.col("f").alias("a"), best.alias("best"))
    kept = kept.select(*_KEYS, "a", "best.l", "best.r", "best.score")
    return _ranked(kept, often, sizes, top)


def _ranked(found: DataFrame, often: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """Phrases in words, and the first of each language. Ranks of salted parts come first, so no task sorts all of a language."""
    names = often.select("id", "lang", "word")
    spelled = found.select(*_KEYS, F.posexplode(F.filter(F.array(*_KEYS), lambda x: x > 0)).alias("at", "id")).join(names, "id").groupBy(*_KEYS).agg(
        F.min("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    rows = found.join(spelled, _KEYS).select("lang", "phrase", "a", "l", "r", "score", F.pmod(F.xxhash64("phrase"), F.lit(256)).alias("_salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_rank") <= top)
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
