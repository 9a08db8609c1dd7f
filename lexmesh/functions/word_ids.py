"""Ids of words, spelled once per task and gathered as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

_KNOWN = 1 << 18  # words a task remembers


class WordIds(dict):
    """Numbers of the words met; ``spell`` gives a word's ids. Look words up between two calls of ``gathered`` only."""

    def __init__(self, spell: Callable[[str], Iterable[int]]):
        super().__init__()
        self._spell, self._sizes, self._flat = spell, [], []

    def __missing__(self, word: str) -> int:
        before = len(self._flat)
        self._flat.extend(self._spell(word))
        self._sizes.append(len(self._flat) - before)
        number = self[word] = len(self)
        return number

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered words one behind the other, bounds of each word); what is remembered stays bounded."""
        sizes = np.array(self._sizes, np.int64)
        starts, each = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = np.array(self._flat, np.int32)[np.repeat(starts - ends[:-1], each) + np.arange(int(ends[-1]))]
        if len(self) > _KNOWN:
            self.clear()
            self._sizes, self._flat = [], []
        return ids, ends
