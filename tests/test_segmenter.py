"""The segmenter of words and the substrings of a block."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lexmesh.operators import unigram
from lexmesh.operators.lattice import Lattice


def test_segmenter_equals_the_lattice():
    """words are segmented one by one, without the substrings of a block."""
    rng = random.Random(5)
    for _ in range(40):
        tokens = sorted({"".join(rng.choice("▁abä") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 25))})
        scores = [-float(rng.randint(1, 6)) for _ in tokens]
        found = unigram._Vocabulary(tokens, [i + 4 for i in range(len(tokens))], scores, 3)
        block = ["▁" + "".join(rng.choice("abäx") for _ in range(rng.randint(0, 9))) for _ in range(30)]
        lattice = Lattice(block, 4)
        number = {t: i for i, t in enumerate(tokens)}
        of = [number.get(p, -1) for p in lattice.pieces()]
        values = np.array([scores[i] if i >= 0 else -np.inf for i in of])
        _, word, piece, known = lattice.best(values, unknown=min(scores) - 10.0)
        for w, text in enumerate(block):
            ids = [of[p] + 4 if k else 3 for x, p, k in zip(word, piece, known) if x == w]
            assert found.segmented(text) == [x for i, x in enumerate(ids) if x != 3 or not i or ids[i - 1] != 3]


def test_substrings_leave_a_block_as_one_array():
    """substrings were joined one character at a time."""
    found = Lattice(["aä😀", "ä😀", ""], 2)
    assert isinstance(found.piece_array(), pa.Array) and found.piece_array().to_pylist() == found.pieces()
    assert sorted(found.pieces()) == sorted(["a", "ä", "😀", "aä", "ä😀"]) and Lattice([], 3).pieces() == []
