"""Draws read off the digits equal comparisons of numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexmesh.functions.hashing import below, uniform
from lexmesh.operators import examples


@pytest.mark.parametrize("share", [0.0, 0.15, 1 / 3, 0.5, 0.999, 1.0, -1.0, 2.0])
def test_below(spark, share):
    df = spark.range(3000).select(below(share, 1, F.lit("x"), "id").alias("a"), (uniform(1, F.lit("x"), "id") < share).alias("b"))
    assert df.filter("a <> b").count() == 0


def test_below_at_a_drawn_value(spark):
    row = spark.range(1).select(uniform(1, "id").alias("u")).first().u
    assert [r[0] for r in spark.range(1).select(F.array(below(row, 1, "id"), below(row + 2.0 ** -52, 1, "id"))).collect()] == [[False, True]]


def test_masks_spell_a_row_once(spark):
    df = spark.createDataFrame([(1, None, [7, 8, 9] * 40), (None, 2, [5, 6] * 40)], "a long, b long, input_ids array<int>")
    found = examples.mask_tokens(df, ["a", "b"], probability=0.3)
    for r in found.collect():
        key = [str(k) for k in (r.a, r.b) if k is not None]
        picks = spark.range(len(r.input_ids)).select((uniform(1, F.lit("pick"), *[F.lit(k) for k in key], "id") < 0.3).alias("p")).collect()
        assert [x != -100 for x in r.mask_labels] == [p.p for p in picks]
    assert found.columns == ["a", "b", "input_ids", "masked_ids", "mask_labels"]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(concat_ws(:, pick" in text and text.count("concat_ws(:, pick") == 1 and "concat_ws(:, 1, pick" not in text
