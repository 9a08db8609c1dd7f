"""Unigram vocabulary training and segmentation.

Words lie in blocks whose substrings are numbered once; piece tables, expected counts and pruning losses are DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.functions.text import WORD_INITIAL, words
from lexmesh.functions.word_ids import WordIds
from lexmesh.operators.lattice import Lattice
from lexmesh.operators.vocabulary import largest
from lexmesh.session import cut_lineage, stored

_BLOCK_WORDS = 1 << 13
_UNKNOWN_PENALTY = 10.0


def seed_pieces(frequencies: DataFrame, max_length: int = 16) -> DataFrame:
    """Frequency of every substring of up to ``max_length`` characters of the marked words."""
    marked = frequencies.select(F.concat(F.lit(WORD_INITIAL), F.col("word")).alias("w"), F.col("n").cast("long").alias("n"))
    length = F.char_length("w")
    substrings = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max_length), length - i + 1)), lambda l: F.substr(F.col("w"), i, l))))
    return marked.select(F.explode(substrings).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))


def seed_vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """All single characters plus the repeated substrings with the largest frequency x length."""
    useful = cut_lineage(counts.filter((F.col("n") > 1) | (F.char_length("piece") == 1)))
    weighted = useful.withColumn("weight", F.col("n") * F.char_length("piece"))
    single = weighted.filter(F.char_length("piece") == 1)
    longer = weighted.filter(F.char_length("piece") > 1)
    return single.unionByName(largest(longer, size, "weight", "piece"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, _BLOCK_WORDS):
            part = batch.slice(low, _BLOCK_WORDS)
            bounds = pa.array([0, part.num_rows], pa.int32())
            columns = [pa.ListArray.from_arrays(bounds, c.cast(t)) for c, t in zip(part.columns, (pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["words", "n"])


def _substrings(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = Lattice(words, longest)
                pieces = found.piece_array()
                counts = found.counts(np.array(n, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pieces), block)), pa.array(np.arange(len(pieces)), pa.int32()), pieces, pa.array(counts)],
                                                 ["block", "code", "piece", "n"])
    return run


def in_blocks(words: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of ``words`` (w, n); the distinct substrings of each block with their number and occurrences), both as tables."""
    blocks = stored(words.select("w", "n").mapInArrow(_blocks, "words array<string>, n array<long>").withColumn("block", F.monotonically_increasing_id()))
    return blocks, stored(blocks.select("block", "words", "n").mapInArrow(_substrings(longest), "block long, code int, piece string, n long"))


def _attached(blocks: DataFrame, held: DataFrame, scores: DataFrame) -> DataFrame:
    """Each block with the pieces that occur in it: their number in the block, id and score."""
    own = held.join(scores.select("id", "score"), "id").groupBy("block").agg(F.collect_list(F.struct("code", "id", "score")).alias("own"))
    return blocks.join(own, "block").select("words", "n", "own")


def _per_block(longest: int, compute, names: list[str]):
    """Runs ``compute(lattice, scores by number, n, ids by number)`` on every block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lattice = Lattice(batch.column(0)[i].as_py(), longest)
                code, ids, score = (batch.column(2)[i].values.field(k).to_numpy() for k in range(3))
                scores, names_of = np.full(len(lattice.example), -np.inf), np.full(len(lattice.example), -1)
                scores[code], names_of[code] = score, ids
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in compute(lattice, scores, np.array(batch.column(1)[i].as_py(), np.int64), names_of)], names)
    return run


def expected_counts(blocks: DataFrame, held: DataFrame, scores: DataFrame, longest: int) -> DataFrame:
    """(id, expected): uses of each piece, expected over all segmentations of all words."""
    def compute(lattice, values, n, ids):
        found = lattice.expected(values, n)
        return ids[ids >= 0], found[ids >= 0]

    partial = _attached(blocks, held, scores).mapInArrow(_per_block(longest, compute, ["id", "expected"]), "id long, expected double")
    return partial.groupBy("id").agg(F.sum("expected").alias("expected"))


def _digamma(x: Column) -> Column:
    y, shift = x + 7, sum((1 / (x + k) for k in range(7)), F.lit(0.0))
    inverse = 1 / (y * y)
    return F.log(y) - 0.5 / y - inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252)) - shift


def maximised(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, size, expected, score) of the pieces expected half a time at least, and of all single characters."""
    counted = scores.select("id", "size").join(expected, "id", "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    kept = stored(counted.filter((F.col("expected") >= 0.5) | (F.col("size") == 1)))
    total = kept.agg(_digamma(F.sum("expected"))).first()[0]
    return kept.withColumn("score", _digamma(F.greatest("expected", F.lit(1e-6))) - F.lit(total))


def losses(blocks: DataFrame, held: DataFrame, scores: DataFrame, longest: int) -> DataFrame:
    """(id, loss): likelihood lost by spelling each longer piece with the others. In these blocks words are pieces and n is their id."""
    def compute(lattice, values, n, ids):
        split = lattice.best(values, split=True)[0]
        whole = np.full(len(n), -np.inf)
        spans = (lattice.start == lattice.first[lattice.word]) & (lattice.end == lattice.last[lattice.word])
        whole[lattice.word[spans]] = values[lattice.piece[spans]]
        here = np.isfinite(whole)
        return n[here], whole[here] - split[here]

    apart = _attached(blocks, held, scores).mapInArrow(_per_block(longest, compute, ["id", "apart"]), "id long, apart double")
    return scores.join(apart, "id").select("id", (F.col("expected") * F.col("apart")).alias("loss"))


def train_unigram(frequencies: DataFrame, vocab_size: int, seed_size: int = 1_000_000, max_length: int = 16, reserved: int = 5,
                  em_rounds: int = 2, shrink: float = 0.75) -> DataFrame:
    """Pieces ``(piece, score)`` of a unigram vocabulary; all single characters are kept.

    Expectation-maximisation alternates with dropping the pieces whose removal costs least. The piece table is a
    DataFrame throughout: blocks of words receive the scores of the pieces that occur in them and send expected counts,
    and the driver sees row counts alone. Null and empty words are left out.
    """
    marked = frequencies.filter(F.col("word") != "").select(F.concat(F.lit(WORD_INITIAL), F.col("word")).alias("w"), F.col("n").cast("long").alias("n"))
    spark = frequencies.sparkSession
    blocks, local = in_blocks(marked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w"), max_length)
    counts = local.groupBy("piece").agg(F.sum("n").alias("n"))
    seeds = stored(seed_vocabulary(counts, seed_size).withColumn("id", F.monotonically_increasing_id()))
    held = stored(local.join(seeds.select("piece", "id"), "piece").select("block", "code", "id"))
    longer = seeds.filter(F.char_length("piece") > 1).select(F.col("piece").alias("w"), F.col("id").alias("n"))
    own_blocks, own_local = in_blocks(longer, max_length)
    own_held = stored(own_local.join(seeds.select("piece", "id"), "piece").select("block", "code", "id"))
    total = seeds.agg(F.log(F.sum("weight"))).first()[0] or 0.0
    scores = seeds.select("id", F.char_length("piece").alias("size"), (F.log("weight") - F.lit(total)).alias("score"))
    target = max(vocab_size - reserved, 1)
    while True:
        for _ in range(em_rounds):
            scores = stored(maximised(scores, expected_counts(blocks, held, scores, max_length)))
        pieces, singles = scores.agg(F.count(F.lit(1)), F.count_if(F.col("size") == 1)).first()
        room = max(int(shrink * (pieces - singles)), target - singles, 0)
        if pieces <= target or pieces - singles <= room:
            break
        kept = largest(losses(own_blocks, own_held, scores, max_length), room, "loss", "id").select("id")
        scores = stored(scores.filter("size = 1").unionByName(scores.filter("size > 1").join(kept, "id", "left_semi")))
    return scores.join(seeds.select("id", "piece"), "id").select("piece", "score")


class _Vocabulary:
    """Pieces of a bounded vocabulary, for one word at a time."""

    def __init__(self, tokens: list[str], ids: list[int], scores: list[float], unknown_id: int):
        self.longest = max(map(len, tokens), default=1)
        self._unknown = (min(scores, default=0.0) - _UNKNOWN_PENALTY, unknown_id)
        # beginnings of pieces tell where no longer piece can follow
        self._found: dict[str, tuple[float, int] | None] = dict.fromkeys(t[:i] for t in tokens for i in range(1, len(t)))
        self._found.update(zip(tokens, zip(scores, ids)))

    def segmented(self, word: str) -> list[int]:
        """Ids of the best segmentation, of equals that with the longest last piece. A run of unknown characters is one unknown piece."""
        found, unknown, size = self._found, self._unknown, len(word)
        best, before, id_of = [0.0] + [-inf] * size, [0] * (size + 1), [0] * (size + 1)
        for start in range(size):
            value = best[start]
            for end in range(start + 1, min(size, start + self.longest) + 1):
                piece = found.get(word[start:end], False)
                if not piece:
                    if end == start + 1:
                        if value + unknown[0] > best[end]:
                            best[end], before[end], id_of[end] = value + unknown[0], start, unknown[1]
                    if piece is False:
                        break
                elif value + piece[0] > best[end]:
                    best[end], before[end], id_of[end] = value + piece[0], start, piece[1]
        path, end = [], size
        while end:
            path.append(id_of[end])
            end = before[end]
        return _one_unknown(path[::-1], unknown[1])


def _one_unknown(ids: list[int], unknown_id: int) -> list[int]:
    return [x for i, x in enumerate(ids) if x != unknown_id or not i or ids[i - 1] != unknown_id]


def _segmenter(vocab: DataFrame, unknown_id: int, max_vocab: int):
    """A function for tasks: the ids of a word, which may hold spaces."""
    rows = vocab.filter(~F.col("is_special")).select("token", "id", "score").limit(max_vocab + 1).collect()
    if len(rows) > max_vocab:
        raise ValueError(f"vocabulary exceeds {max_vocab} entries")
    shared = vocab.sparkSession.sparkContext.broadcast(([r.token for r in rows], [r.id for r in rows], [float(r.score) for r in rows]))

    def make():
        known = _Vocabulary(*shared.value, unknown_id)

        def spell(word: str) -> list[int]:
            parts = word.split()
            if parts == [word]:
                return known.segmented(WORD_INITIAL + word)
            return _one_unknown([x for part in parts for x in known.segmented(WORD_INITIAL + part)], unknown_id)

        return spell

    return make


def _gathered(known: WordIds, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one behind the other, bounds of each word): distinct words are segmented, the rest is an array gather."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    return known.gathered(np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()])


def _added(batch: pa.RecordBatch, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])


def _with_ids(df: DataFrame, vocab: DataFrame, source: Column, nested: bool, unknown_id: int, max_vocab: int) -> DataFrame:
    """``ids`` from the words in ``source``. Texts are not shuffled; the words are split in the JVM and travel beside the row."""
    make = _segmenter(vocab, unknown_id, max_vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(make())
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            ids, ends = _gathered(known, lists.values.slice(bounds[0], bounds[-1] - bounds[0]))
            bounds = bounds - bounds[0]
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            values = pa.array(ids, pa.int32())
            if nested:
                inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), inner)
            else:
                found = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), values)
            yield _added(rest, found)

    ids_type = T.ArrayType(T.ArrayType(T.IntegerType())) if nested else T.ArrayType(T.IntegerType())
    return df.withColumn("_words", source).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("ids", ids_type)]))


def encode_lines(lines: DataFrame, vocab: DataFrame, unknown_id: int = 3, max_vocab: int = 4_000_000) -> DataFrame:
    """Add ``ids``, the piece ids of the line's words, without shuffling any text. A null line has none.

    A batch's distinct words are segmented once each, and a task remembers words it has met, so nothing is joined on hot words.
    """
    return _with_ids(lines, vocab, F.coalesce(F.filter(words(F.col("line")), lambda w: w != ""), F.array().cast("array<string>")), False, unknown_id, max_vocab)


def encode_words(sentences: DataFrame, vocab: DataFrame, unknown_id: int = 3, max_vocab: int = 4_000_000) -> DataFrame:
    """Add ``ids``, one array of piece ids per entry of ``words``."""
    return _with_ids(sentences, vocab, F.col("words"), True, unknown_id, max_vocab)
