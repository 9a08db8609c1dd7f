"""Collocations, packing and divergence: brute force in plain Python on fixtures that hold every odd case."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import TESTDATA
from lexmesh.llm import collocations, divergence, packing, runs
from lexmesh.llm.queries import op12_packing

SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["block", "codes", "w1", "f", "id", "word", "term", "g", "slice", "postings", "total", "v", "_hash", "segment", "rank", "item", "n"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_rows(seed, count=300):
    rng = random.Random(seed)
    parts = ["the", "The", "new york", "new york city", "ét\xe9", "東京", "a\x01b", "don't", "x", "of the", ".", ", ", "!?", "\n", "\x0b", "\t", " ", "tok3n", "1 2", "\U0001f600"]
    rows = [(i, rng.choice([" ", " ", ""]).join(rng.choice(parts) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "\xe9", None]))
            for i in range(count)]
    return rows + [(None, "new york city " * 50, "en", "s1"), (1, None, "en", "s3"), (1, "", None, None), (2, rows[2][1], "en", "s2"), (2, rows[2][1], "en", "s2"), (7, "lonely", "xx", "only")]


def plain_collocations(rows, least, inside, top):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in kept.items():
        if any(100 * b >= inside * a for (l2, q), b in kept.items() if l2 == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("seed,least,segment,block", [(1, 30, 1 << 20, 1 << 20), (2, 5, 40, 60), (3, 2, 7, 9)])
def test_collocations(spark, monkeypatch, seed, least, segment, block):
    """Small segments and blocks cut phrases, texts and runs at every place."""
    monkeypatch.setattr(collocations, "_SEGMENT_WINDOWS", segment)
    monkeypatch.setattr(collocations, "_BLOCK_WORDS", block)
    rows = odd_rows(seed)
    found = collocations.collocations(frame(spark, rows).repartition(3), least=least, top=25).collect()
    assert {tuple(r) for r in found} == plain_collocations(rows, least, 80, 25) and len(found) == len({(r.lang, r.rank) for r in found})


def test_collocations_of_a_cut_text(monkeypatch):
    """A text longer than a slice and a block gives the same words, pieces and shared borders."""
    import pyarrow as pa
    rng = random.Random(5)
    text = "".join(rng.choice(["ab ", "c ", "d. ", "\n", "eee ", " "]) for _ in range(3000))
    monkeypatch.setattr(runs, "SLICE", 50)
    monkeypatch.setattr(collocations, "_BLOCK_WORDS", 40)
    starts = Counter()
    for batch in collocations._blocks(iter([pa.RecordBatch.from_pydict({"lang": ["x", "y"], "text": [text, "ab c"]})])):
        codes = runs.unsqueezed(batch.column(0)[0].as_py())[0]
        words, counts = (batch.column(i)[0].as_py() for i in (3, 4))
        assert Counter(words[c - 1] for c in codes[:batch.column(1)[0].as_py()] if c) == {w: n for w, n in Counter(dict()).items()} | {w: sum(n for x, n in zip(words, counts) if x == w) for w in set(words) if sum(n for x, n in zip(words, counts) if x == w)}
        for i in range(batch.column(1)[0].as_py()):
            window = []
            for c in codes[i:i + 4]:
                if not c:
                    break
                window.append(words[c - 1])
            if window:
                starts[tuple(window)] += 1
    expected = Counter()
    for piece in [*re.split("[.\n]", text), "ab c"]:
        words = piece.split()
        expected.update(tuple(words[i:i + 4]) for i in range(len(words)))
    assert starts == expected


@pytest.mark.parametrize("name", ["collocations", "divergence", "packing"])
def test_empty_tables(spark, name):
    empty = frame(spark, [])
    run = {"collocations": collocations.collocations, "divergence": divergence.source_divergence, "packing": lambda d: packing.pack(d, TOKENIZER)}[name]
    assert run(empty).count() == 0
    blank = frame(spark, [(1, None, None, None), (2, "", "en", "a"), (3, " \n", "en", "b")])
    assert run(blank).count() == {"collocations": 0, "divergence": 2, "packing": 3}[name]


def plain_divergence(rows, least, top):
    rows = [(i, lower(t), lang or "", source or "") for i, t, lang, source in rows]
    docs, counts, groups = Counter(), Counter(), {(lang, source) for _, _, lang, source in rows}
    for _, text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (l2, t), d in docs.items() if l2 == lang and d >= least]
        sources = sorted(s for l2, s in groups if l2 == lang)
        c = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        c[None] = {t: sum(c[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (x + 1) // (sum(of.values()) + len(kept)) for t, x in of.items()} for s, of in c.items()}
        apart = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(apart(p[s][t], p[None][t]), t) for t in kept if c[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize("block,postings,held,scatter", [(64, 1 << 20, 1 << 20, 1 << 20), (2, 5, 10, 3)])
def test_divergence(spark, monkeypatch, block, postings, held, scatter):
    for name, value in (("_BLOCK_SOURCES", block), ("_SLICE_POSTINGS", postings), ("_HELD", held), ("_SCATTER", scatter)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_rows(11)
    found = divergence.source_divergence(frame(spark, rows).repartition(3), top_terms=4).collect()
    assert {tuple(r) for r in found} == plain_divergence(rows, 3, 4) and len(found) == len(set(found))


def test_divergence_of_long_texts(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(runs, "SLICE", 40)
    text = "Aa bb c\xe9 " * 30
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "x"], "source": ["s", "s"], "text": [text, "bb"]})
    found = [r for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    assert {(r["term"], r["n"], r["docs"]) for r in found} == {("aa", 30, 1), ("bb", 31, 2), ("c\xe9", 30, 1)}


def test_shares_are_exact():
    rng = np.random.default_rng(3)
    whole = rng.integers(2, 9 * 10**15, 2000)
    count = (whole * rng.random(2000)).astype(np.int64).clip(0, whole - 1)
    assert divergence._share(count, whole).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(count.tolist(), whole.tolist())]


TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")


def checked(pieces, texts):
    """Every token in one piece, sequences gapless and at most 4096 wide, checksums of the library's ids; returns (padding, tokens)."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(TOKENIZER)
    left = Counter()
    for doc_id, text in texts:
        left[doc_id, tuple([*library.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (doc_id, ids), times in left.items():
        for _ in range(times):
            at = 0
            while at < len(ids):
                piece = next(r for r in documents[doc_id] if r.start == at and r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()) == r.ids_crc32)
                documents[doc_id].remove(piece)
                at += piece.length
            assert at == len(ids)
    assert not any(documents.values())
    padding = 0
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end and length > 0
            end += length
        assert end <= 4096
        padding += 4096 - end if end & (end - 1) else 0
    return padding, sum(n for s in sequences.values() for _, n in s)


def test_packing(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    padding, tokens = checked(op12_packing(spark, TESTDATA).collect(), texts)
    assert padding <= 0.02 * tokens


def test_packing_of_odd_texts(spark):
    rows = odd_rows(4, 60) + [(90, "nosentenceend " * 9000, "en", "s"), (91, "<|endoftext|> <|ENDOFTEXT|>x A<|startoftext|>B a.'s it'S İΣ Σ. x'll'd Å ½ é Å\x85b c", "en", "s"), (None, None, "en", "s"), (92, "z" * 9000, "en", "s")]
    padding, tokens = checked(packing.pack(frame(spark, rows).repartition(2), TOKENIZER).collect(), [r[:2] for r in rows])
    assert padding <= 0.05 * tokens


def test_packing_by_slices(monkeypatch):
    import pyarrow as pa
    texts = [(1, "one two. three " * 40), (2, None), (3, "\xe9t\xe9, ok! " * 500), (4, "x"), (5, "five\nsix " * 90)]
    monkeypatch.setattr(runs, "SLICE", 100)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts]})
    pieces = [type("P", (), r)() for b in packing._packed(TOKENIZER, 4096)(iter([batch])) for r in b.to_pylist()]
    checked(pieces, texts)
    assert min(p.sequence_id for p in pieces) == 3 << 33


@pytest.mark.parametrize("seed", range(30))
def test_cuts_cost_least(seed):
    rng = np.random.default_rng(seed)
    at = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 60)))).astype(np.int64) + 100
    penalty = rng.choice([0, 4, 20], len(at)).astype(np.int64)
    width = 32

    def cost(cuts):
        sizes = np.diff(at[cuts])
        assert (sizes <= width).all() and cuts[0] == 0
        return int(sum(0 if n & (n - 1) == 0 else width - n for n in sizes) + penalty[cuts[1:]].sum() + 1 * len(sizes))

    best = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = int(at[j] - at[i])
            if n <= width:
                best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else width - n) + int(penalty[j]) + 1)
    cuts = packing.best_cuts(at, penalty, width, True)
    assert cuts[-1] == len(at) - 1 and cost(cuts) == best[-1]
    early = packing.best_cuts(at, penalty, width, False)
    assert cost(early) == best[early[-1]] == min(best[i] for i in range(1, len(at)) if at[-1] - at[i] <= width)
