"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from conftest import TESTDATA

ROWS_ONLY = {"fit_pca", "project_pca", "train_bpe", "train_probe", "train_unigram", "zero_shot_evaluation"}


@pytest.fixture(scope="module")
def duck():
    return connect(TESTDATA)


# the pipeline's queries have tests of their own in tests/llm
OWN = sorted(q for q in entry.queries() if not re.match(r"op\d+_|pipeline$", q))


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, TESTDATA)
    if name in ROWS_ONLY:
        assert name not in entry.oracle_sql() and df.count() > 0
    else:
        assert compare(df, duck, entry.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_unigram_pieces_come_from_the_whole_corpus(spark):
    pieces = {r.piece for r in entry.queries()["train_unigram"](spark, TESTDATA).collect()}
    text = {c for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect() for c in r.text if not c.isspace()}
    assert len(pieces) > 400 and len(text - pieces) <= len(text) // 100
