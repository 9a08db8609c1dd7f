"""Order-preserving packing of tokenized documents into sequences of fixed width, by dynamic programming.

Every task packs its own documents in the order of their ids, so nothing is shuffled. Its tokens are one stream; a
sequence is a stretch of it. Cuts lie at ends of documents (free) or sentences, or, where a text has no sentence end for
long, at every 64th token; cuts inside a document cost a penalty. A sequence costs its padding, none if its length is a
power of two. With cost c(i) of the best cuts up to position x(i), the next cut j takes the smallest c(i) + x(i) of the
positions that lie at most a width back: the front of a monotone queue. Powers of two are looked up as further edges.
Cuts are settled for about a million tokens at a time, at the cheapest position of the last width, and what lies
behind goes on from there: memory does not grow with documents or tasks. Only a task's end is forced; near it every
token may be a cut, so that the rest falls into powers of two.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm import runs

END = 2  # closes every document
WIDTH = 4096
SENTENCE_CUT = 16
OTHER_CUT = 64  # penalties in tokens of padding
SEQUENCE_COST = 1  # keeps free powers of two from shredding documents
_STEP = 64
_HORIZON = 1 << 20
_KNOWN = 1 << 18
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("A"):ord("Z") + 1] = _ASCII_LETTER[ord("a"):ord("z") + 1] = True
_OTHER = _WORD & ~_ASCII_LETTER  # digits and signs of ASCII without the apostrophe
_OTHER[0x80:] = False
_OTHER[ord("'")] = False
_PLAIN_WORD = re.compile(rb"(?:[a-z]|\xC3[\xA0-\xB6\xB8-\xBF])+")
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}  # the byte alphabet of the model's words
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _letters(data: np.ndarray, first: bool) -> np.ndarray:
    """Bytes that begin (or end) a letter of ASCII or of the Latin letters behind byte 0xC3."""
    lead, tail = data[:-1] == 0xC3, (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    pair = np.zeros(len(data), bool)
    pair[slice(0, -1) if first else slice(1, None)] = lead & tail
    return _ASCII_LETTER[data] | pair


def _fast(word: bytes) -> bool:
    """Lower-case ASCII and Latin letters only: one word of the model, which no normalisation changes."""
    return _PLAIN_WORD.fullmatch(word) is not None


class Encoder:
    """Token ids of texts.

    Texts are cut at white space and between letters and other signs, where the model's own words end in any case (an
    apostrophe stays with its letters, other characters beyond ASCII with what follows them, and what may hold a special
    token stays whole). Each different part is encoded once while it is remembered: plain words by the model alone, others with all that the tokenizer does to a text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self._number: dict[bytes, int] = {}
        self._ids, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        found: list = [[t.id for t in self._model.tokenize(w.decode("latin-1").translate(_BYTE_SIGNS))] if _fast(w) else None for w in words]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self._tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self._number) > _KNOWN:
            self._forget()
        new = [w for w in words if w not in self._number]
        if new:
            ids = self._encoded(new)
            self._number.update(zip(new, range(len(self._number), len(self._number) + len(new))))
            self._ids = np.concatenate((self._ids, np.fromiter(chain.from_iterable(ids), np.uint32)))
            self._sizes = np.concatenate((self._sizes, np.fromiter(map(len, ids), np.int64, len(ids))))
            self._starts = np.cumsum(self._sizes) - self._sizes
        return np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))

    def slice(self, part: runs.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows of the slice, where each row's end, token positions of sentence ends)."""
        data = runs.LOWER[part.data]
        other = _OTHER[data]
        split = np.zeros(len(data), bool)
        split[1:] = _letters(data, False)[:-1] & other[1:] | other[:-1] & _letters(data, True)[1:]
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        if len(special):  # may be a special token, which is found in the text as it is
            chunk = np.cumsum(~_WORD[data])
            whole = np.isin(chunk, chunk[special])
            split &= ~whole
            data = np.where(whole, part.data, data)
        first, end, row = runs.words(data, part.starts, _WORD, split)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(part.starts), np.int64), np.zeros(0, np.int64)
        codes, words = runs.distinct(data, _WORD, first, end)
        number = self._numbers(words.to_pylist())[codes]
        sizes = self._sizes[number]
        ends = np.cumsum(sizes)
        ids = self._ids[np.repeat(self._starts[number] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        lines = np.cumsum(data == 0x0A)
        open_end = np.append(~_WORD[data], True)
        stop = _STOP[data[end - 1]] & open_end[end]
        stop[:-1] |= lines[first[1:]] > lines[first[:-1]]
        return ids, np.concatenate(([0], ends))[np.searchsorted(row, np.arange(len(part.starts)), side="right")], ends[stop]


def candidates(marks: np.ndarray, before: int) -> np.ndarray:
    """Further places to cut, so that none lies more than a step behind ``before`` or the mark before it."""
    previous = np.concatenate(([before], marks[:-1]))
    more = (marks - previous - 1) // _STEP
    return np.repeat(previous, more) + _STEP * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)


def best_cuts(at: np.ndarray, penalty: np.ndarray, width: int, last: bool, cost: int = SEQUENCE_COST) -> list[int]:
    """Indices of the cuts of least cost from ``at[0]``: to the last position, or (not ``last``) to the cheapest one of the last width."""
    n = len(at)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    power = 1
    while power < width:
        to = np.searchsorted(at, at - power)
        hit = np.flatnonzero(at[to] == at - power)
        edges.append((hit, to[hit]))
        power *= 2
    into, out = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
    order = np.argsort(into, kind="stable")
    into, out = [*into[order].tolist(), n], out[order].tolist()
    x, fee = at.tolist(), (penalty + cost).tolist()
    total, back = [0] * n, [0] * n
    queue, keys, head, edge = [], [], 0, 0
    for j in range(1, n):
        key = total[j - 1] + x[j - 1]
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j - 1)
        keys.append(key)
        low = x[j] - width
        while x[queue[head]] < low:
            head += 1
        best, where = keys[head] - low, queue[head]
        while into[edge] == j:
            i = out[edge]
            edge += 1
            if total[i] < best:
                best, where = total[i], i
        total[j], back[j] = best + fee[j], where
    j = n - 1
    if not last:
        near = int(np.searchsorted(at, at[-1] - width))
        j = min(range(max(1, near), n), key=lambda i: (total[i], -i))
    path = [j]
    while j:
        j = back[j]
        path.append(j)
    return path[::-1]


class Packer:
    """A task's stream of documents; settled stretches come out as pieces."""

    def __init__(self, width: int, first_sequence: int, horizon: int = _HORIZON):
        self.width, self.sequence, self.horizon = width, first_sequence, horizon
        self.start = self.end = self.marked = 0  # of what is not settled yet; place of the last mark
        self.first = 0  # place of the first token held
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, first place, end
        self.at, self.penalty = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, names: list[int | None], ids: np.ndarray, ends: np.ndarray, sentences: np.ndarray, goes_on: bool = False) -> None:
        """Tokens of rows that end at ``ends``; the last row may go on. Documents get their closing id here."""
        closed = ends[:len(ends) - goes_on]
        sentences = sentences[~np.isin(sentences, closed)]
        begin = self.docs.pop()[1] if self.docs and self.docs[-1][2] < 0 else self.end
        places = self.end + closed + np.arange(1, len(closed) + 1)
        starts = [begin, *places[:len(ends) - 1].tolist()]
        self.docs += zip(names, starts, [*places.tolist(), *[-1] * goes_on])
        marks = np.concatenate((self.end + sentences + np.searchsorted(closed, sentences), places))
        penalty = np.repeat([SENTENCE_CUT, 0], [len(sentences), len(places)])
        order = np.argsort(marks, kind="stable")
        marks, penalty = marks[order], penalty[order]
        if len(marks):
            more = candidates(marks, self.marked)
            self.marked = int(marks[-1])
            marks, penalty = np.concatenate((marks, more)), np.concatenate((penalty, np.full(len(more), OTHER_CUT)))
            order = np.argsort(marks, kind="stable")
            self.at.append(marks[order])
            self.penalty.append(penalty[order])
        self.tokens.append(np.insert(ids, closed, END))
        self.end += len(self.tokens[-1])

    def settled(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        closed = next((d[2] for d in reversed(self.docs) if d[2] >= 0), self.start)
        while closed > self.start and (last or closed - self.start >= self.horizon):
            at, penalty = np.concatenate(self.at), np.concatenate(self.penalty)
            high = int(np.searchsorted(at, min(closed, self.start + self.horizon), side="right"))
            places, penalties = at[:high], penalty[:high]
            whole = last and places[-1] == closed
            if whole:  # the end is forced: cuts anywhere near it let the rest fall into powers of two
                more = np.setdiff1d(np.arange(max(self.start + 1, closed - 2 * self.width), closed), places)
                places, penalties = np.concatenate((places, more)), np.concatenate((penalties, np.full(len(more), OTHER_CUT)))
                order = np.argsort(places, kind="stable")
                places, penalties = places[order], penalties[order]
            cuts = best_cuts(np.concatenate(([self.start], places)), np.concatenate(([0], penalties)), self.width, whole)
            chosen = np.concatenate(([self.start], places))[cuts]
            yield self._pieces(chosen)
            keep = int(np.searchsorted(at, chosen[-1], side="right"))
            self.at, self.penalty = [at[keep:]], [penalty[keep:]]
            self.start = int(chosen[-1])
            self.docs = [d for d in self.docs if d[2] < 0 or d[2] > self.start]

    def _pieces(self, cuts: np.ndarray) -> pa.RecordBatch:
        tokens = np.concatenate(self.tokens).astype("<u4", copy=False)
        docs = [d for d in self.docs if d[2] >= 0]
        starts, ends = (np.array([d[i] for d in docs]) for i in (1, 2))
        begin = np.unique(np.concatenate((cuts[:-1], starts[(starts > cuts[0]) & (starts < cuts[-1])])))
        end = np.append(begin[1:], cuts[-1])
        doc = np.searchsorted(starts, begin, side="right") - 1
        window = np.searchsorted(cuts, begin, side="right") - 1
        sums = [zlib.crc32(tokens[s:e]) for s, e in zip((begin - self.first).tolist(), (end - self.first).tolist())]
        columns = [[docs[d][0] for d in doc.tolist()], begin - starts[doc], end - begin, sums, (ends - starts)[doc], self.sequence + window, begin - cuts[window]]
        self.sequence += len(cuts) - 1
        self.tokens, self.first = [tokens[cuts[-1] - self.first:]], int(cuts[-1])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])


def _packed(path: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(path), Packer(width, TaskContext.get().partitionId() << 33)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for part in runs.slices(batch.column(1), _WORD):
                packer.add(names[part.row:part.row + len(part.starts)], *encoder.slice(part), part.goes_on)
                yield from packer.settled()
        yield from packer.settled(last=True)
    return run


def pack(docs: DataFrame, path: str, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``width`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a tokenizer file at the same place on every executor; each document's tokens end with id 2. Every token lies in
    exactly one piece, and pieces fill their sequence from offset 0 without gaps, in the order of ids (rows without an id first,
    equal ids by a hash of the text) within a task. Null and empty texts are one token; rows that repeat an id are documents of
    their own; texts of any length are read in slices and cut where need be. ``sequence_id`` is unique, not dense: it holds the
    task's number. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    if width < 2 * _STEP:
        raise ValueError(f"width must be at least {2 * _STEP}")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("_hash", F.xxhash64("text")).sortWithinPartitions("doc_id", "_hash").select("doc_id", "text")
    return ordered.mapInArrow(_packed(path, width), PIECES)
