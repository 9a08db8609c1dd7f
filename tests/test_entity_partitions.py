"""What a task of the entity metrics sorts."""

from __future__ import annotations

import pytest

from lexmesh.plans import tagged_queries
from lexmesh.plans.registry import Tables

ODD = "　 Naïve kala  kümneteist1 \x1c x\r\n\r\n\ttäht😀se seitse7 yksteisttä   \rend\n \x85 \n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(1, ODD, "et", "a"), (2, None, "et", "a"), (3, "", None, "b"), (4, "One two\nthree Four Five", "fi", "b"), (None, "no id", "fi", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_entities_are_sorted_in_small_partitions(spark, folder):
    """F16: a task sorted the words of one of as many partitions as a shuffle has."""
    wanted = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = tagged_queries.ner_f1(Tables(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert f", {wanted}), REPARTITION_BY_NUM" in plan
