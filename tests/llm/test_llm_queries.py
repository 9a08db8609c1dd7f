"""Queries of the dealt operators against SQL, the libraries or brute force on whole small tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from conftest import TESTDATA

SQL = [q for q in entry.queries() if q in entry.oracle_sql() and q.startswith("op") and q[2].isdigit()]


@pytest.fixture(scope="module")
def duck():
    return connect(TESTDATA)


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, TESTDATA)
    assert compare(df, duck, entry.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_every_operator_is_registered():
    numbers = sorted(int(q[2:].split("_")[0]) for q in entry.queries() if q.startswith("op") and q[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_secret_scan_runs_no_python(spark):
    plan = entry.queries()["op3_secret_scan"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_languages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    rows = entry.queries()["op1_language_id"](spark, TESTDATA).collect()
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert found.keys() == lang.keys()
    assert sum(r.page_id is not None for r in rows) == spark.read.parquet(f"{TESTDATA}/pages.parquet").count()
    assert np.mean([found[i].lang == lang[i] for i in lang]) >= 0.98
    assert np.mean([r.keep for r in rows]) >= 0.99


def test_recall(spark):
    rows = spark.read.parquet(f"{TESTDATA}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    found: dict[int, list] = {}
    for r in entry.queries()["op2_nearest_neighbours"](spark, TESTDATA).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        best = [ids[i] for i in np.lexsort((ids, -scores)) if i != q][:20]
        own = sorted(found[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert all(abs(s - x[q] @ x[ids == v][0]) < 1e-12 for _, v, s in own)
        hits, total = hits + len({v for _, v, _ in own} & set(best)), total + len(best)
    assert hits / total >= 0.9


def test_pieces_equal_the_library(spark):
    import sentencepiece

    from lexmesh.llm.queries import SENTENCEPIECE_MODEL
    model = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    rows = entry.queries()["op6_sentencepiece"](spark, TESTDATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(model.encode(texts[r.doc_id]), "<i4")
        assert (r.n_pieces, r.ids_sha256, r.round_trip) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)
