"""Segmentation lattices of many words at once, in arrays.

The suffixes of a block of words are sorted (cut at the longest piece) and their common prefixes measured: equal
substrings lie together, so every distinct substring of the block gets a number, its occurrences are the arcs of the
lattices, and a table of pieces meets a block as one value per number. Sums and maxima over paths advance all words
by one position at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


class Lattice:
    """All substrings of up to ``longest`` characters of ``words`` as arcs between the positions of each word."""

    def __init__(self, words: Sequence[str], longest: int):
        sizes = np.array([len(w) for w in words], np.int64)
        self.joined = "".join(words)
        self.text = np.frombuffer(self.joined.encode("utf-32-le"), "<u4").astype(np.int64)
        offsets = np.cumsum(sizes) - sizes
        self.first = offsets + np.arange(len(words))  # a word has one node more than characters
        self.last = self.first + sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(self.text)) - offsets[word]
        left = sizes[word] - place
        order, common = self._suffixes(left, longest)
        starts, numbers, lengths, examples, base = [], [], [], [], 0
        for length in range(1, min(longest, int(sizes.max(initial=0))) + 1):
            fits = left[order] >= length
            at = order[fits]
            if not len(at):
                break
            kind = np.cumsum(common < length)[fits]
            fresh = np.ones(len(at), bool)
            fresh[1:] = kind[1:] != kind[:-1]
            starts.append(at)
            numbers.append(np.cumsum(fresh) - 1 + base)
            lengths.append(np.full(len(at), length))
            examples.append(at[fresh])
            base += int(fresh.sum())
        none = np.zeros(0, np.int64)
        start, self.piece, length = (np.concatenate(x) if x else none for x in (starts, numbers, lengths))
        self.word = word[start] if len(start) else none
        self.start, self.level_from = start + self.word, place[start] if len(start) else none
        self.end, self.level_to = self.start + length, self.level_from + length
        self.example = np.concatenate(examples) if examples else none
        self.length = np.repeat([x[0] for x in lengths], [len(x) for x in examples]) if lengths else none
        self.nodes = len(self.text) + len(words)

    def _suffixes(self, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes, and how many characters each shares with the one before it (-1 for the first)."""
        letters, code = np.unique(self.text, return_inverse=True)
        kind = next(np.dtype(t) for t in (np.uint8, np.uint16, np.uint32) if len(letters) < np.iinfo(t).max)
        each = 8 // kind.itemsize  # letters in a key
        table = np.zeros((len(self.text), -(-longest // each) * each), kind.newbyteorder(">"))
        for i in range(longest):
            inside = np.flatnonzero(left > i)
            table[inside, i] = code[inside + i] + 1
        order = np.lexsort(table.view(">u8").astype(np.uint64).T[::-1])
        table = table[order]
        common = np.full(len(order), -1)
        common[1:] = np.logical_and.accumulate(table[1:] == table[:-1], axis=1).sum(axis=1)
        return order, common

    def pieces(self) -> list[str]:
        """The substring behind each number."""
        return self.piece_array().to_pylist()

    def piece_array(self) -> pa.Array:
        bytes_of = 1 + (self.text >= 0x80) + (self.text >= 0x800) + (self.text >= 0x10000)
        at = np.concatenate(([0], np.cumsum(bytes_of)))
        sizes = at[self.example + self.length] - at[self.example] if len(self.example) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(at[self.example] - ends[:-1], sizes) + np.arange(int(ends[-1]))
        data = np.frombuffer(self.joined.encode(), np.uint8)[source]
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())

    def counts(self, n: np.ndarray) -> np.ndarray:
        """Occurrences of each substring in words that occur ``n`` times."""
        total = np.zeros(len(self.example), np.int64)
        np.add.at(total, self.piece, n[self.word])
        return total

    def _advance(self, arcs: np.ndarray, weight: np.ndarray, forward: bool, best: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-sum (or maximum) over the paths from a word's start to each node, or from each node to its end; and the best arc."""
        source, target = (self.start, self.end) if forward else (self.end, self.start)
        level = self.level_to[arcs] if forward else -self.level_from[arcs]
        # one key of level, target and source; no two arcs have the same ends
        apart = source[arcs] - target[arcs]
        lowest, width = (int(apart.min()), int(np.ptp(apart)) + 1) if len(arcs) else (0, 1)
        order = np.argsort(((level - (level.min() if len(arcs) else 0)) * self.nodes + target[arcs]) * width + (apart - lowest))
        arcs, weight, level = arcs[order], weight[order], level[order]
        value = np.full(self.nodes, -np.inf)
        value[self.first if forward else self.last] = 0.0
        chosen = np.full(self.nodes, -1)
        bounds = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1], [True]))) if len(level) else np.zeros(1, np.int64)
        for low, high in zip(bounds[:-1], bounds[1:]):
            into, v = target[arcs[low:high]], value[source[arcs[low:high]]] + weight[low:high]
            fresh = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
            most = np.maximum.reduceat(v, fresh)
            each = np.diff(np.append(fresh, len(v)))
            if best:
                value[into[fresh]] = most
                hit = np.flatnonzero(v == np.repeat(most, each))
                node, first = np.unique(into[hit], return_index=True)
                chosen[node] = arcs[low + hit[first]]  # of equals the longest piece
            else:
                held = np.where(np.isfinite(most), most, 0.0)
                with np.errstate(divide="ignore"):
                    value[into[fresh]] = held + np.log(np.add.reduceat(np.exp(v - np.repeat(held, each)), fresh))
        return value, chosen

    def expected(self, scores: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected uses of each substring over all segmentations; minus infinity stands for no piece. Words without one count nothing."""
        arcs = np.flatnonzero(np.isfinite(scores[self.piece]))
        weight = scores[self.piece[arcs]]
        before, _ = self._advance(arcs, weight, True, False)
        behind, _ = self._advance(arcs, weight, False, False)
        whole = before[self.last][self.word[arcs]]
        use = np.isfinite(whole) & np.isfinite(before[self.start[arcs]]) & np.isfinite(behind[self.end[arcs]])
        arcs, weight, whole = arcs[use], weight[use], whole[use]
        mass = np.exp(before[self.start[arcs]] + weight + behind[self.end[arcs]] - whole) * n[self.word[arcs]]
        return np.bincount(self.piece[arcs], weights=mass, minlength=len(self.example))

    def best(self, scores: np.ndarray, unknown: float | None = None, split: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score of each word's best segmentation; word, substring, whether it is a piece, of all parts in order).

        A character that is no piece costs ``unknown``, if given. ``split`` forbids the word itself as a piece.
        """
        held = np.isfinite(scores[self.piece])
        if split:
            held &= (self.start != self.first[self.word]) | (self.end != self.last[self.word])
        weight = np.where(held, scores[self.piece], -np.inf if unknown is None else unknown)
        arcs = np.flatnonzero(held if unknown is None else held | (self.length[self.piece] == 1))
        value, chosen = self._advance(arcs, weight[arcs], True, True)
        score = value[self.last]
        node, at, parts = self.last.copy(), np.flatnonzero(np.isfinite(score) & (self.last > self.first)), []
        while len(at):
            arc = chosen[node[at]]
            parts.append(arc)
            node[at] = self.start[arc]
            at = at[node[at] > self.first[at]]
        arcs = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        arcs = arcs[np.lexsort((self.start[arcs], self.word[arcs]))]
        return score, self.word[arcs], self.piece[arcs], held[arcs]
