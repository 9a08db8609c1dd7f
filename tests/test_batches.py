"""Numbered rows, pieces of words and pairs of lines: nothing costly is computed twice."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.functions import word_ids
from lexmesh.functions.numbering import number_rows
from lexmesh.functions.word_ids import WordIds
from lexmesh.plans import vocab_queries
from lexmesh.plans.inputs import hashed_pieces
from lexmesh.plans.registry import Tables

ODD = "　 Naïve kala  kümneteist1 \x1c x\r\n\r\n\ttäht😀se seitse7 yksteisttä   \rend\n \x85 \n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(1, ODD, "et", "a"), (2, None, "et", "a"), (3, "", None, "b"), (4, "One two\nthree Four Five", "fi", "b"), (None, "no id", "fi", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_rows_are_numbered_without_computing_them_twice(spark):
    """F8, F11: finding the ranges of the sort used to run everything before it once more."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).mapInArrow(count, "id long")
    found = number_rows(df, ["id"]).collect()
    assert sorted((r.id, r.row_no) for r in found) == [(i, i + 1) for i in range(1000)] and seen.value == 1000


def test_pairs_of_lines_encode_each_line_once(spark, folder):
    """both sides of the join used to encode the words."""
    plan = vocab_queries.add_special_template(Tables(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Generate" not in plan


def test_piece_ids_are_digests_of_pieces(spark):
    found = hashed_pieces(spark.createDataFrame([(1, "kala tähtsust kümnekeelx a")], "k long, line string"), "line", 3, without=10).first()
    pieces = [["▁kal", "a"], ["▁täh", "tsu", "st"], [], ["▁a"]]
    expected = spark.createDataFrame([(p,) for ps in pieces for p in ps], "p string").select(
        (F.conv(F.substring(F.md5("p"), 1, 7), 16, 10).cast("long") % 32763 + 5).alias("x")).collect()
    assert [x for ids in found.ids for x in ids] == [r.x for r in expected] and list(map(len, found.ids)) == list(map(len, pieces))


def test_word_ids_forget_between_batches():
    known = WordIds(lambda w: [len(w)] * len(w))
    for _ in range(3):
        ids, ends = known.gathered(np.array([known[w] for w in ("ab", "", "abc", "ab")]))
        assert ids.tolist() == [2, 2, 3, 3, 3, 2, 2] and ends.tolist() == [0, 2, 2, 5, 7]
        known.update({str(i): 0 for i in range(word_ids._KNOWN)})
        known.gathered(np.array([0]))
        assert not known
