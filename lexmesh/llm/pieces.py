"""SentencePiece encoding and decoding as a parallel scan over the (max, +) semiring.

A sequence of pieces is the byte-pair encoding of a text exactly if each two neighbours, put together, encode to
themselves. So the encoding is the one path of weight 0 through a lattice in which a piece that follows an
incompatible one weighs minus infinity. Its state at a place in the text is the piece that covers the character before it.
A giant document is cut into chunks of fixed length, wherever that falls. Each chunk yields the matrix of best weights from the states
at its left border to those at its right border; products of these matrices are associative, so prefixes and
suffixes of a document are combined in two levels; the state where prefix and suffix meet at 0 is the piece at the border. With
the states of both borders known every chunk is traced back by itself. Between two characters that no piece holds
side by side there is always a border, so a matrix takes a few characters' work at either end of the chunk.
Inside a chunk, and in a text that is one chunk, there is such a border before every word: a word's matrix is 1 x 1, a product of them adds
up weights of 0, and the path of a text is that of its words, one behind the other. A task walks the lattices of its distinct words together, place by place.

The model's file is read by the driver and sent to the tasks as a table of pieces; it is never trained here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm import runs
from lexmesh.llm.storage import written

SPACE = "▁"
CHUNK = 1 << 15
_FANOUT = 128
_CACHE = 1 << 17
_KNOWN = 1 << 18
_TOGETHER = 1 << 14  # words whose lattices are walked together
_SHORT = 64  # characters of such words
_NO_SPACE = np.arange(256) != 0x20
_BLOCKED = -np.inf


class Vocabulary:
    """Pieces of a byte-pair model with byte fallback, whose only normalisation is the space marker and one in front."""

    def __init__(self, names: list[str], scores: list[float | None], bytes_at: list[int]):
        self.names, self.bytes_at, self._given = names, bytes_at, scores
        byte_of = {i: b for b, i in enumerate(bytes_at)}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else name.encode() for i, name in enumerate(names)]
        self.ids = {p: i for i, (p, score) in enumerate(zip(names, scores)) if score is not None}
        self.scores = {p: score for p, score in zip(names, scores) if score is not None}
        self.longest = max(map(len, self.scores))
        self.beside = {p[i:i + 2] for p in self.scores for i in range(len(p) - 1)}
        # if no piece goes on behind a word with the next space marker, each word is encoded for itself
        self.by_word = not any(b == SPACE and a != SPACE for a, b in self.beside)
        self.word = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.by_word else r"(?s).+")
        self._words: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def __reduce__(self):
        return Vocabulary, (self.names, self._given, self.bytes_at)

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Byte-pair encoding of a short text: the best pair first, the leftmost of equals, while there are more than ``least`` parts."""
        parts, gain = list(text), self.scores.get
        gains = [gain(a + b, _BLOCKED) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and (best := max(gains)) > _BLOCKED:
            at = gains.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = gain(parts[at - 1] + parts[at], _BLOCKED)
            if at < len(gains):
                gains[at] = gain(parts[at] + parts[at + 1], _BLOCKED)
        return parts

    def stable(self, piece: str) -> bool:
        """Whether the piece can occur in an encoding."""
        return len(piece) == 1 or (piece in self.scores and self.follows("", piece))

    def follows(self, a: str, b: str) -> bool:
        """Whether b can stand right behind a."""
        if a and a[-1] + b[0] not in self.beside:
            return True
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= _CACHE:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(a + b) == [x for x in (a, b) if x]
        return known

    def numbers(self, piece: str) -> tuple[int, ...]:
        found = self.ids.get(piece)
        return (found,) if found is not None else tuple(self.bytes_at[b] for b in piece.encode())

    def word_ids(self, word: str) -> tuple[int, ...]:
        known = self._words.get(word)
        if known is None:
            if len(self._words) >= _CACHE:
                self._words.clear()
            known = tuple(i for p in self.trace(word, 0, "", None) for i in self.numbers(p))
            if len(word) <= _SHORT:
                self._words[word] = known
        return known

    # -- the lattice ------------------------------------------------------------------------------------------------

    def pieces_at(self, text: str, start: int) -> Iterator[str]:
        yield text[start]
        for end in range(start + 2, min(len(text), start + self.longest) + 1):
            if text[start:end] in self.scores and self.stable(text[start:end]):
                yield text[start:end]

    def states(self, text: str, border: int) -> list[tuple[int, int]]:
        """(start, end) of each piece that can cover the character before ``border``, in a fixed order."""
        return [(s, s + len(p)) for s in range(max(0, border - self.longest), border) for p in self.pieces_at(text, s) if s + len(p) >= border]

    def reach(self, text: str, begin: int, last: str, stop: int) -> list[dict[str, tuple[int, str]]]:
        """For each place from ``begin`` the pieces that can end there with weight 0, and the (start, piece) before each.

        ``last`` is the piece that ends at ``begin``; pieces start before ``stop``. Between places that no
        piece spans there is one way on, so only that is kept.
        """
        ends: list[dict[str, tuple[int, str]]] = [{} for _ in range(len(text) - begin + 1)]
        ends[0][last] = (-1, "")
        for at in range(begin, stop):
            if before := ends[at - begin]:
                for piece in self.pieces_at(text, at):
                    for previous in before:
                        if not previous or self.follows(previous, piece):
                            ends[at + len(piece) - begin].setdefault(piece, (at, previous))
                            break
        return ends

    def trace(self, text: str, begin: int, last: str, leave: tuple[int, int] | None) -> list[str]:
        """Pieces behind ``last``, which ends at ``begin``, up to and with the piece (start, end) ``leave``, or to the text's end."""
        end, piece = (leave[1], text[leave[0]:leave[1]]) if leave else (len(text), None)
        if begin == end:
            return []
        ends = self.reach(text[:end], begin, last, end)
        if piece is None:
            piece = next(iter(ends[end - begin]))
        out, at = [], end
        while at > begin:
            start, previous = ends[at - begin][piece]
            out.append(piece)
            at, piece = start, previous
        return out[::-1]


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file, on the driver: a table as large as the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(count)]
    names = [model.id_to_piece(i) for i in range(count)]
    at = {n: i for i, n in enumerate(names)}
    return Vocabulary(names, [None if s else model.get_score(i) for i, s in enumerate(special)], [at[f"<0x{b:02X}>"] for b in range(256)])


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode_text(vocabulary: Vocabulary, text: str) -> list[int]:
    out: list[int] = []
    known, look = vocabulary._words.get, vocabulary.word_ids
    for word in vocabulary.word.findall(marked(text)):
        out += known(word) or look(word)
    return out


def decode_ids(vocabulary: Vocabulary, ids, first: bool = True) -> str:
    """Text of the ids; ``first`` says that they start a document, whose leading space was added by the encoder."""
    raw = vocabulary.raw
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if first and text.startswith(" ") else text


# -- chunks of giant documents ------------------------------------------------------------------------------------------


def _sure(vocabulary: Vocabulary, text: str, places: range) -> int | None:
    """The first of the places between whose two characters no piece can lie."""
    return next((i for i in places if text[i - 1:i + 1] not in vocabulary.beside), None)


def transfer(vocabulary: Vocabulary, left: str, body: str, right: str, first: bool, final: bool) -> np.ndarray:
    """Best weights (0 or minus infinity) from the states at the left border of a chunk to those at its right border."""
    text = left + body + right
    low, high = len(left), len(left) + len(body)
    entries = [None] if first else vocabulary.states(text, low)
    exits = [None] if final else vocabulary.states(text, high)
    # the last certain border of the chunk: what leaves it to the right does not depend on the entry
    middle = None
    cut = _sure(vocabulary, text, range(high - 1, low + vocabulary.longest, -1))
    if cut is not None:
        middle = _sure(vocabulary, text, range(low + vocabulary.longest, cut + 1))

    def row(begin: int, last: str) -> np.ndarray:
        ends = vocabulary.reach(text[:high] if final else text, begin, last, high)
        if final:
            return np.array([0.0 if ends[high - begin] else _BLOCKED])
        return np.array([0.0 if text[s:e] in ends[e - begin] and ends[e - begin][text[s:e]][0] == s else _BLOCKED for s, e in exits])

    if middle is None:
        rows = []
        for entry in entries:
            s, e = entry or (0, 0)
            if entry and e > high:  # the piece covers the whole chunk
                rows.append(np.array([0.0 if x == entry else _BLOCKED for x in exits]))
            elif entry and e == high:
                rows.append(np.array([0.0]) if final else np.array([0.0 if x == entry else _BLOCKED for x in exits]))
            else:
                rows.append(row(e, text[s:e] if entry else ""))
        return np.array(rows).reshape(len(entries), len(exits))
    leaving = row(cut, "")
    reached = []
    for entry in entries:
        s, e = entry or (0, 0)
        ends = vocabulary.reach(text[:middle], e, text[s:e] if entry else "", middle) if e <= middle else None
        reached.append(0.0 if ends is not None and ends[middle - e] else _BLOCKED)
    return np.array(reached)[:, None] + leaving[None, :]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product."""
    return np.stack([np.max(row[:, None] + b, axis=0) for row in a])


def _packed(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int32).tobytes() + np.packbits(m == 0.0).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    rows, columns = np.frombuffer(data, np.int32, 2)
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[8:], count=int(rows) * int(columns)).reshape(rows, columns)
    return np.where(bits == 1, 0.0, _BLOCKED)


def _scan(own: str):
    """Index of the state at the left border of each part of a document, by prefix and suffix products of its parts."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(own).reset_index(drop=True)
        matrices = [_unpacked(m) for m in frame["matrix"]]
        into, out = np.zeros((1, matrices[0].shape[0])), np.zeros((matrices[-1].shape[1], 1))
        if "enter" in frame:
            into[:], out[:] = _BLOCKED, _BLOCKED
            into[0, int(frame["enter"].iloc[0])] = 0.0
            out[int(frame["leave"].iloc[0]), 0] = 0.0
        suffixes = [out]
        for m in reversed(matrices):
            suffixes.append(combine(m, suffixes[-1]))
        suffixes.reverse()
        states, prefix = [], into
        for m, suffix in zip([*matrices, None], suffixes):
            states.append(int(np.argmax(prefix[0] + suffix[:, 0])))
            if m is not None:
                prefix = combine(prefix, m)
        return pd.DataFrame({"doc": frame["doc"], own: frame[own], "from_state": states[:-1], "to_state": states[1:]})
    return run


def _product(frame: pd.DataFrame) -> pd.DataFrame:
    total = None
    for data in frame.sort_values("chunk")["matrix"]:
        total = _unpacked(data) if total is None else combine(total, _unpacked(data))
    return pd.DataFrame({"doc": [frame["doc"].iloc[0]], "block": [frame["block"].iloc[0]], "matrix": [_packed(total)]})


def _chunks(size: int, margin: int):
    """Parts of marked texts that are longer than one chunk, each with the characters next to it."""
    names = ["doc", "chunk", "block", "final", "left", "body", "right"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), *[pa.string()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = marked(value.as_py())
                for k, at in enumerate(range(0, len(text), size)):
                    end = min(len(text), at + size)
                    values = [doc, k, k // _FANOUT, end == len(text), text[max(0, at - margin):at], text[at:end], text[end:end + margin]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)
    return run


def _transfers(vocabulary_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("left", "body", "right", "chunk", "final")))
            packed = [_packed(transfer(vocabulary_of.value, left, body, right, chunk == 0, final)) for left, body, right, chunk, final in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("chunk"), batch.column("block"), pa.array(packed, pa.binary())], ["doc", "chunk", "block", "matrix"])
    return run


def trace_chunk(vocabulary: Vocabulary, words: _Words, left: str, body: str, right: str, first: bool, final: bool, enter: int, leave: int) -> list[int]:
    """Ids of the pieces that start in a chunk, given the states at its borders."""
    text = left + body + right
    low, high = len(left), len(left) + len(body)
    begin, last, leave_at = 0, "", None
    if not first:
        s, begin = vocabulary.states(text, low)[enter]
        last = text[s:begin]
    if final:
        text = text[:high]
    else:
        leave_at = vocabulary.states(text, high)[leave]
        if leave_at[0] < low:  # the piece that covers the left border covers the right one too
            return []
    until = high if final else leave_at[0]
    near = _sure(vocabulary, text, range(begin, until + (not final)))
    if near is None:
        return [i for p in vocabulary.trace(text, begin, last, leave_at) for i in vocabulary.numbers(p)]
    # between certain borders the path goes through the words' own lattices; the ends of the chunk have states of their own
    far = until if final else _sure(vocabulary, text, range(until, near - 1, -1))
    ids = [i for p in vocabulary.trace(text[:near], begin, last, None) for i in vocabulary.numbers(p)]
    ids += words.ids_of(text[near:far])
    if not final:
        ids += [i for p in vocabulary.trace(text, far, "", leave_at) for i in vocabulary.numbers(p)]
    return ids


def _traced(vocabulary_of, lattice_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of.value
        words = _Words(vocabulary, lattice_of.value)
        for batch in batches:
            ids, texts = [], []
            for left, body, right, chunk, final, enter, leave in zip(*(batch.column(n).to_pylist() for n in ("left", "body", "right", "chunk", "final", "from_state", "to_state"))):
                ids.append(trace_chunk(vocabulary, words, left, body, right, chunk == 0, final, enter, leave))
                texts.append(decode_ids(vocabulary, ids[-1], chunk == 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc", "chunk", "ids", "text"])
    return run


class _Table:
    """Numbers by key (both from 0 up) in an open hash table, looked up for whole arrays; -1 for other keys."""

    def __init__(self, numbers: dict[int, int]):
        keys, values = np.array(list(numbers), np.int64), np.array(list(numbers.values()), np.int32)
        bits = max(4, len(keys).bit_length() + 2)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._home(keys)
        while len(keys):
            slot, first = np.unique(at, return_index=True)
            first = first[self._keys[slot] < 0]
            self._keys[at[first]], self._values[at[first]] = keys[first], values[first]
            keys, values, at = np.delete(keys, first), np.delete(values, first), (np.delete(at, first) + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self._mask
            found, wanted = self._keys[at], keys[open_]
            hit = found == wanted
            out[open_[hit]] = self._values[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], at[more]
        return out


class Lattice:
    """The pieces that can stand at a place, and the weight of a piece behind another, looked up for many places at once.

    Symbols are the numbers of pieces; behind them come letters that pieces are made of but that are none, and one for all other letters.
    """

    def __init__(self, vocabulary: Vocabulary):
        v, self._pieces = vocabulary, len(vocabulary.names)
        symbol = dict(v.ids)
        for letter in sorted({c for p in v.scores for c in p} - symbol.keys()):
            symbol[letter] = self._pieces + len(symbol.keys() - v.ids.keys())
        self._other = self._pieces + len(symbol) - len(v.ids)
        self._size = self._other + 1
        order = {score: k for k, score in enumerate(sorted({v.scores[p] for p in v.scores if len(p) > 1}, reverse=True), 1)}
        last = {p: v.merge(p, least=2) for p in symbol}
        stable = {p: parts for p, parts in last.items() if len(parts) <= 2}
        # of a longer piece: when it is made, and of which two
        self._rank, self._left, self._right = (np.zeros(self._size, np.int64) for _ in range(3))
        for p, parts in stable.items():
            if len(parts) == 2:
                self._rank[symbol[p]], self._left[symbol[p]], self._right[symbol[p]] = order[v.scores[p]], symbol[parts[0]], symbol[parts[1]]
        self._pairs = _Table({symbol[p[:k]] * self._size + symbol[p[k:]]: order[v.scores[p]] for p in v.scores for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol})
        nodes = {"": 0}
        for p in stable:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        kinds = {c: k for k, c in enumerate(sorted({c for p in stable for c in p}), 1)}
        self._kinds, self._kind = len(kinds) + 1, np.zeros(0x110000, np.int16 if len(kinds) < 1 << 15 else np.int32)
        for c, k in kinds.items():
            self._kind[ord(c)] = k
        self._children = _Table({nodes[q[:-1]] * self._kinds + kinds[q[-1]]: n for q, n in nodes.items() if q})
        self._symbol = np.array([symbol[q] if q in stable else -1 for q in nodes], np.int64)
        self._longest, self._bytes_at = v.longest, np.array(v.bytes_at, np.int64)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b can stand right behind a: merges are undone from the last one back, none across the border may come before the one undone."""
        out, left = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(left):
            made = self._pairs.get(a * self._size + b)
            bad = (made >= 0) & (made < limit)
            out[left[bad]] = False
            when_a, when_b = self._rank[a], self._rank[b]
            more = ~bad & ((when_a > 0) | (when_b > 0))
            left, a, b, when_a, when_b = left[more], a[more], b[more], when_a[more], when_b[more]
            first = when_a > when_b  # of equals the left one is made first
            limit = np.where(first, when_a, when_b + 1)
            a, b = np.where(first, self._right[a], a), np.where(first, b, self._left[b])
        return out

    def _edges(self, kind: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first letter, length, symbol) of every piece that can stand in the words; ``room`` is the rest of a letter's word."""
        at, node, found = np.arange(len(kind)), np.zeros(len(kind), np.int64), []
        for size in range(1, self._longest + 1):
            node = self._children.get(node * self._kinds + kind[at + size - 1]).astype(np.int64)
            if size == 1:
                found.append((at[node < 0], size, np.full(int((node < 0).sum()), self._other)))
            at, node = at[node >= 0], node[node >= 0]
            symbols = self._symbol[node]
            found.append((at[symbols >= 0], size, symbols[symbols >= 0]))
            on = room[at] > size
            at, node = at[on], node[on]
            if not len(at):
                break
        firsts, sizes, symbols = zip(*found)
        return np.concatenate(firsts), np.repeat(np.array(sizes), [len(x) for x in firsts]), np.concatenate(symbols)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words; how many each has): the path of weight 0 through each word's lattice.

        The words' places are passed in step. A place is reached by the piece whose weight behind the piece that reached its start
        is 0; every beginning of a word has one encoding, so there is one such piece.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        word = np.repeat(np.arange(len(words)), sizes)
        within = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first, length, symbol = self._edges(self._kind[letters], sizes[word] - within)
        stop = within[first] + length
        order = np.argsort(stop.astype(np.int16 if len(words) and sizes.max() < 1 << 15 else np.int64), kind="stable")
        begin, symbol = (first + word[first])[order], symbol[order]  # a word has one place more than it has letters
        end, bounds = begin + length[order], np.concatenate(([0], np.cumsum(np.bincount(stop))))
        state, back = np.full(len(letters) + len(words), -1, np.int64), np.zeros(len(letters) + len(words), np.int64)
        for low, high in zip(bounds[1:-1].tolist(), bounds[2:].tolist()):
            before = state[begin[low:high]]
            weight = np.zeros(high - low)
            inner = np.flatnonzero(before >= 0)
            weight[inner] = np.where(self.follows(before[inner], symbol[low:high][inner]), 0.0, _BLOCKED)
            best = low + np.flatnonzero(weight == 0.0)
            state[end[best]], back[end[best]] = symbol[best], begin[best]
        ends = np.cumsum(sizes) + np.arange(len(words))
        used, at = np.zeros(len(state), bool), ends[sizes > 0]
        while len(at):
            used[at] = True
            at = back[at]
            at = at[state[at] >= 0]
        places = np.flatnonzero(used)
        ids, owner = state[places], np.searchsorted(ends, places)
        spelled = np.flatnonzero(ids >= self._pieces)
        if len(spelled):  # letters that are no pieces, by their bytes
            codes, which = np.unique(letters[places[spelled] - owner[spelled] - 1], return_inverse=True)
            spelling = [np.frombuffer(chr(c).encode(), np.uint8) for c in codes]
            table = np.full((len(codes), 4), -1)
            for k, x in enumerate(spelling):
                table[k, :len(x)] = self._bytes_at[x]
            wide = np.full((len(ids), 4), -1)
            wide[:, 0] = ids
            wide[spelled] = table[which]
            ids, owner = wide[wide >= 0], np.repeat(owner, (wide >= 0).sum(axis=1))
        return ids.astype(np.int32), np.bincount(owner, minlength=len(words))


class _Words:
    """Ids of the words a task has met, as arrays by number; at most ``_KNOWN`` words are remembered."""

    def __init__(self, vocabulary: Vocabulary, lattice: Lattice):
        self._vocabulary, self._lattice = vocabulary, lattice
        spelled = [x.replace(SPACE.encode(), b" ") for x in vocabulary.raw]
        self._letters = np.frombuffer(b"".join(spelled), np.uint8)
        self._long = np.array([len(x) for x in spelled])
        self._at = np.cumsum(self._long) - self._long
        self._forget()

    def _decoded(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that the ids of all words decode to; how many are each word's)."""
        long = self._long[ids]
        upto = np.concatenate(([0], np.cumsum(long)))
        data = self._letters[np.repeat(self._at[ids] - upto[:-1], long) + np.arange(int(upto[-1]))]
        return data, np.diff(upto[np.concatenate(([0], np.cumsum(sizes)))])

    def _back(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each word's ids decode to the word."""
        data, found = self._decoded(ids, sizes)
        given, wanted = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        same = found == wanted
        wrong = data[np.repeat(same, found)] != given[np.repeat(same, wanted)]
        same[np.repeat(np.arange(len(words))[same], wanted[same])[wrong]] = False
        return same

    def _forget(self) -> None:
        self._number: dict[bytes, int] = {}
        self._ids, self._sizes, self._whole = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self._number) > _KNOWN:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self._number]
        if new:
            v = self._vocabulary
            names = [w.decode().replace(" ", SPACE) for w in new]
            short = [i for i, name in enumerate(names) if len(name) <= _SHORT]
            parts, owners = [], []
            for low in range(0, len(short), _TOGETHER):  # bounds the memory of a step
                part = short[low:low + _TOGETHER]
                found, many = self._lattice.encoded([names[i] for i in part])
                parts.append(found)
                owners.append(np.repeat(part, many))
            for i, name in enumerate(names):
                if len(name) > _SHORT:
                    parts.append(np.array([x for p in v.trace(name, 0, "", None) for x in v.numbers(p)], np.int32))
                    owners.append(np.full(len(parts[-1]), i))
            owner = np.concatenate(owners)
            ids, sizes = np.concatenate(parts), np.bincount(owner, minlength=len(new))
            if len(short) < len(new):
                ids = ids[np.argsort(owner, kind="stable")]
            back = self._back(new, ids, sizes)
            self._number.update(zip(new, range(len(self._number), len(self._number) + len(new))))
            self._ids, self._sizes, self._whole = np.concatenate((self._ids, ids)), np.concatenate((self._sizes, sizes)), np.concatenate((self._whole, back))
            self._starts = np.cumsum(self._sizes) - self._sizes
        return np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))

    def _gathered(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self._sizes[number]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return self._ids[np.repeat(self._starts[number] - upto[:-1], sizes) + np.arange(int(upto[-1]))], upto

    def ids_of(self, text: str) -> list[int]:
        """Ids of a marked text between two certain borders."""
        words = self._vocabulary.word.findall(text)
        if not self._vocabulary.by_word:
            return [i for word in words for i in self._vocabulary.word_ids(word)]
        return self._gathered(self._numbers([w.replace(SPACE, " ").encode() for w in words]))[0].tolist() if words else []

    def encoded(self, part: runs.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows; bounds of each row; whether decoding gives each row back).

        A word begins where spaces begin, with the space that encoding puts in front of a text. As a word starts with the marker, which is
        a piece, bytes of a character never lie in two words, so a text decodes to its words' texts.
        """
        ends = np.append(part.starts[1:], len(part.data))
        data = np.insert(part.data, part.starts[ends > part.starts], 0x20)
        bounds = np.concatenate(([0], np.cumsum(ends - part.starts + (ends > part.starts))))
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        first = np.flatnonzero(begins)
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64), np.ones(len(bounds) - 1, bool)
        offsets = np.append(first, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, upto = self._gathered(number)
        at = np.searchsorted(first, bounds)
        lost = np.concatenate(([0], np.cumsum(~self._whole[number])))
        return ids, upto[at], lost[at[1:]] == lost[at[:-1]]


def _whole(vocabulary_of, lattice_of, keep_ids: bool):
    """Documents of one chunk, whose two borders are the document's.

    Where no piece reaches from one word into the next, the lattices of a batch's distinct words are walked once and ids gathered; with other
    models a text is one lattice. The marker itself in a text is a space there, and does not come back.
    """
    names, kinds = ["n_pieces", "ids_sha256", "round_trip", "ids"], (pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))

    def singly(vocabulary: Vocabulary, column: pa.Array) -> list[pa.Array]:
        out: list[list] = [[] for _ in range(4)]
        for value in column:
            text = value.as_py() or ""
            ids = encode_text(vocabulary, text)
            for held, x in zip(out, (len(ids), _digest(np.array(ids, "<i4")), decode_ids(vocabulary, ids) == text, ids if keep_ids else None)):
                held.append(x)
        return [pa.array(c, t) for c, t in zip(out, kinds)]

    def together(words: _Words, part: runs.Slice) -> list[pa.Array]:
        ids, bounds, back = words.encoded(part)
        flat = ids.astype("<i4", copy=False)
        digests = [_digest(flat[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        held = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)) if keep_ids else pa.nulls(len(digests), kinds[3])
        return [pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.string()), pa.array(back), held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of.value
        words = _Words(vocabulary, lattice_of.value)
        for batch in batches:
            column = batch.column(1)
            if not vocabulary.by_word or SPACE not in vocabulary.scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), *singly(vocabulary, column)], ["doc_id", *names])
                continue
            spaced = pc.replace_substring(column, SPACE, " ")
            same = pc.fill_null(pc.equal(spaced, column), True)
            for part in runs.slices(spaced, _NO_SPACE, whole=True):
                counts, digests, back, held = together(words, part)
                back = pc.and_(back, same.slice(part.row, len(back)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.row, len(back)), counts, digests, back, held], ["doc_id", *names])
    return run


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.tobytes()).hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_digest(np.asarray(x.values, "<i4")) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc", "ids_sha256"])


def _states(chunks: DataFrame, vocabulary_of) -> DataFrame:
    """The states at both borders of each chunk: a scan inside blocks of chunks, one over the blocks, and back."""
    matrices = written(chunks.mapInArrow(_transfers(vocabulary_of), "doc string, chunk int, block int, matrix binary"), "transfers")
    blocks = written(matrices.groupBy("doc", "block").applyInPandas(_product, "doc string, block int, matrix binary"), "block-transfers")
    between = blocks.groupBy("doc").applyInPandas(_scan("block"), "doc string, block int, from_state int, to_state int")
    sides = between.withColumnsRenamed({"from_state": "enter", "to_state": "leave"})
    inside = matrices.join(sides, ["doc", "block"]).groupBy("doc", "block")
    return inside.applyInPandas(_scan("chunk"), "doc string, chunk int, from_state int, to_state int")


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_sha256 (of 32-bit little-endian ids), round_trip and, if asked for, ids.

    Equals the library's encoding with the same model. Null and empty texts have no pieces. ``round_trip`` says that decoding
    gives back the text; only the marker U+2581 itself does not come back, as it decodes to a space. Rows that repeat an id
    or a text are each returned; null ids are kept. Texts of more than ``chunk`` characters are cut into chunks that
    different tasks work on. Extra columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = read_vocabulary(model)
    shared, lattice = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(Lattice(vocabulary))  # as large as the vocabulary
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    long = F.coalesce(F.char_length("text"), F.lit(0)) >= chunk
    plain = "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean, ids array<int>"
    small = rows.filter(~long).mapInArrow(_whole(shared, lattice, keep_ids), plain)

    giants = rows.filter(long).withColumn("doc", F.sha2("text", 256))
    contents = giants.groupBy("doc").agg(F.first("text").alias("text"))
    cut = contents.mapInArrow(_chunks(chunk, vocabulary.longest), "doc string, chunk int, block int, final boolean, left string, body string, right string")
    chunks = written(cut, "chunks")
    traced = chunks.join(_states(chunks, shared), ["doc", "chunk"]).mapInArrow(_traced(shared, lattice), "doc string, chunk int, ids array<int>, text string")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids", "text"))).alias("parts")
    joined = written(traced.groupBy("doc").agg(ordered).select("doc", F.flatten("parts.ids").alias("ids"), F.sha2(F.array_join("parts.text", ""), 256).alias("decoded")), "encoded")
    digests = joined.select("doc", "ids").mapInArrow(_digests, "doc string, ids_sha256 string")
    ids = F.col("ids") if keep_ids else F.lit(None).cast("array<int>")
    found = giants.select("doc_id", "doc").join(joined, "doc").join(digests, "doc")
    large = found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_sha256", (F.col("decoded") == F.col("doc")).alias("round_trip"), ids.alias("ids"))
    out = small.unionByName(large)
    return out if keep_ids else out.drop("ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(shared.value, x) if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
