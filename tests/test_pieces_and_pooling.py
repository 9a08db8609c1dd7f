"""Pieces of words, lines and pooled vectors: rows that the queries' tables do not hold, and what is shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexmesh.functions.text import chunk_pieces
from lexmesh.operators import embed
from lexmesh.operators.vocabulary import attach_ids
from lexmesh.sources.corpus import drop_blank


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [3, 4])
def test_chunk_pieces(spark, size):
    rows = ["", None, "a", "abc", "abcd", "a\nbc\r\n", "😀😀é😀", "▁a▁", "x" * 12]
    df = spark.createDataFrame([(w,) for w in rows], "w string").select("w", chunk_pieces(F.col("w"), size).alias("p"))
    found = {r.w: r.p for r in df.collect()}
    assert found == {w: [("▁" if i == 0 else "") + w[i:i + size] for i in range(0, len(w or ""), size)] for w in rows}
    assert "sequence(" not in plan(df)


def test_a_line_is_stripped_once(spark):
    rows = ["", None, " \t", "\x1c ", " a b　", "c"]
    df = drop_blank(spark.createDataFrame([(x,) for x in rows], "line string"))
    assert sorted(r.line for r in df.collect()) == ["a b", "c"]
    assert plan(df).count("regexp_replace") == 1


def test_pooling_shuffles_ids_not_vectors(spark):
    words = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3), (None, 1), ("c", None), ("d", 9)], "word string, id long")
    pieces = spark.createDataFrame([(1, [1.0, 0.0]), (2, [4.0, 3.0]), (3, [0.5, 0.5])], "id long, vector array<float>")
    expected = {"a": [3.0, 2.0], "b": [0.5, 0.5], None: [1.0, 0.0]}
    vocab = spark.createDataFrame([("x", 1)], "token string, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (1 << 20, 2):
            df = embed.pool_word_vectors(words, pieces, limit)
            assert {r.word: pytest.approx(r.vector) for r in df.collect()} == expected
        text = plan(embed.pool_word_vectors(words, pieces))
        assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
        assert "SortMergeJoin" not in plan(attach_ids(words.withColumnRenamed("word", "token").drop("id"), vocab))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
