"""The pipeline against plain Python, stage by stage on what the stage before kept."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from conftest import TESTDATA
from lexmesh.llm.decontaminate import ERRORS, WINDOW
from lexmesh.llm.storage import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def dedup_lines(docs: dict[int, str]) -> dict[int, str]:
    keys = {i: [lower(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")] for i, t in docs.items()}
    first: dict[str, int] = {}
    for i in sorted(keys):
        for k in keys[i]:
            first.setdefault(k, i)
    return {i: "\n".join(x for x, k in zip(t.split("\n"), keys[i]) if len(k) < 10 or first[k] == i) for i, t in docs.items()}


def shingles(text: str) -> frozenset:
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def representatives(docs: dict[int, str]) -> set[int]:
    sets, parent = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                shared = len(a & b)
                if 4 * shared >= 3 * (len(a) + len(b) - shared):
                    low, high = sorted((find(i), find(j)))
                    parent[high] = low
    return {i for i in docs if find(i) == i}


def contaminated(text: str, items: list[str]) -> bool:
    w = WORD.findall(lower(text))
    for item in items:
        t = WORD.findall(lower(item))
        for shift in range(-len(w), len(t)):
            same = [w[p] == t[p + shift] for p in range(max(0, -shift), min(len(w), len(t) - shift))]
            if any(sum(same[k:k + WINDOW]) >= WINDOW - ERRORS for k in range(len(same) - WINDOW + 1)):
                return True
    return False


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{TESTDATA}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, TESTDATA), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        out.append(docs)
    return out


def texts(df) -> dict[int, str]:
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, stages):
    before = texts(spark.read.parquet(f"{TESTDATA}/documents.parquet"))
    accepted = texts(stages[0])
    assert accepted.items() <= before.items() and len(accepted) >= 0.99 * len(before)
    lines = texts(stages[1])
    assert lines == dedup_lines(accepted)
    near = texts(stages[2])
    assert near == {i: lines[i] for i in representatives(lines)}
    items = [r.text for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    clean = texts(stages[3])
    assert clean == {i: t for i, t in near.items() if not contaminated(t, items)}
    from lexmesh.llm.pieces import decode
    from lexmesh.llm.queries import SENTENCEPIECE_MODEL
    assert {r.doc_id: r.text for r in decode(stages[4], SENTENCEPIECE_MODEL).collect()} == clean


def test_run_gives_the_last_stage(spark, stages):
    rows = lambda df: sorted((r.doc_id, r.n_pieces, r.ids_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, TESTDATA)) == rows(stages[-1])
