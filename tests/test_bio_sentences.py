"""Sentences built from lines equal sentences built from word rows."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from lexmesh.operators import tagged
from lexmesh.plans import tagged_queries as queries
from lexmesh.plans.bindings import LINE_KEY, bio


def test_lines_that_share_a_key_become_one_instance(spark):
    rows = [(1, "Ann met Bo\n\n the End", "en", "a"), (1, "so Far Away", "en", "b"), (1, "x Y", None, "a"), (None, "No Id here", "en", "a"),
            (None, "Nor here", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (3, "Ends WITH Big", "und", "a")]
    t = SimpleNamespace(spark=spark, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    tokens = bio(t).select(*LINE_KEY, "lang", "word_no", F.col("word").alias("token"), F.lower("word").alias("span_text"), "tag")
    expected = sorted(map(repr, tagged.bio_instances(tokens, LINE_KEY).collect()))
    found = queries.instances(t)
    assert sorted(map(repr, found.collect())) == expected and len(expected) == 5
    assert "collect_list(struct" not in found._jdf.queryExecution().executedPlan().toString()


def test_groups_hold_the_rows_of_all_lines_of_a_key(spark):
    rows = [(1, "Ann met", "en", "a"), (1, "so Bo", "en", "b")]
    t = SimpleNamespace(spark=spark, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    found = [r.group for r in queries.bio_groups(t).collect()]
    assert found == ["Ann ann B-PER\nso so O\nBo bo B-LOC\nmet met O\n"] or found == ["Ann ann B-PER\nso so O\nBo bo B-LOC\nmet met O"], found
