"""Distributed numbering against plain Python, whatever the partitioning and skew."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmesh.functions.numbering import head_per_group, number_rows, rank_by_hash, running
from lexmesh.session import lookup


def skewed(spark, partitions):
    # group "a" holds far more than a third of the rows
    return spark.range(3000).repartition(partitions).select(
        F.col("id").alias("k"), F.when(F.col("id") % 10 < 8, "a").when(F.col("id") % 10 == 8, "b").otherwise("c").alias("g"))


def digest(seed, k):
    return hashlib.md5(f"{seed}:{k}".encode()).hexdigest()


@pytest.mark.parametrize("partitions,buckets", [(1, 1), (7, 64), (5, 5000)])
def test_rank_by_hash(spark, partitions, buckets):
    df = skewed(spark, partitions)
    found = {(r.g, r.k): (r.rank, r.n) for r in rank_by_hash(df, 7, ["k"], by=["g"], total="n", buckets=buckets).collect()}
    for g in "abc":
        keys = sorted((k for k in range(3000) if ("a" if k % 10 < 8 else "b" if k % 10 == 8 else "c") == g), key=lambda k: digest(7, k))
        assert [found[g, k] for k in keys] == [(i + 1, len(keys)) for i in range(len(keys))]


@pytest.mark.parametrize("keep", [1, 37, 299, 10_000])
def test_keep_is_a_prefix_of_the_full_rank(spark, keep):
    df = skewed(spark, 3)
    full = rank_by_hash(df, 1, ["k"], by=["g"])
    for by in (["g"], []):
        full = rank_by_hash(df, 1, ["k"], by=by).filter(F.col("rank") <= keep)
        assert sorted(full.collect()) == sorted(rank_by_hash(df, 1, ["k"], by=by, keep=keep, buckets=50).collect())


@pytest.mark.parametrize("by", [[], ["g"]])
def test_number_rows_by_checkpoint_equals_window(spark, by):
    df = skewed(spark, 6)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    plain = df.withColumn("row_no", F.row_number().over(group.orderBy("k")).cast("long")).withColumn("n", F.count(F.lit(1)).over(group))
    found = number_rows(df, ["k"], by=by, total="n")
    assert sorted(plain.select("k", "g", "row_no", "n").collect()) == sorted(found.select("k", "g", "row_no", "n").collect())
    assert sorted(number_rows(df, ["k"], by=by).columns) == ["g", "k", "row_no"]


@pytest.mark.parametrize("keep", [1, 50, 5000])
def test_head_per_group(spark, keep):
    found = head_per_group(skewed(spark, 4), keep, "g", ["k"], bins=64)
    by_group = {}
    for r in found.collect():
        by_group.setdefault(r.g, []).append((r.row_no, r.k))
    for g, got in by_group.items():
        keys = [k for k in range(3000) if ("a" if k % 10 < 8 else "b" if k % 10 == 8 else "c") == g][:keep]
        assert sorted(got) == [(i + 1, k) for i, k in enumerate(keys)]


@pytest.mark.parametrize("how,inclusive", [("sum", True), ("sum", False), ("max", True), ("max", False)])
def test_running_across_chunks(spark, how, inclusive):
    values = [(g, i, (i * 37 + len(g)) % 11) for g in ("x", "yy") for i in range(1, 200)]
    df = spark.createDataFrame(values, "g string, i long, v long").repartition(5)
    found = {(r.g, r.i): (r.r, r.whole) for r in running(df, ["g"], "i", F.col("v"), "r", how, inclusive, total="whole", chunk=16).collect()}
    reduce = sum if how == "sum" else max
    for g in ("x", "yy"):
        series = [v for gg, _, v in values if gg == g]
        for i in range(1, 200):
            seen = series[:i] if inclusive else series[:i - 1]
            assert found[g, i] == (reduce(seen) if seen else None, reduce(series))


def test_lookup_is_chosen_by_bytes_and_complete(spark):
    big, small = skewed(spark, 4), spark.createDataFrame([("a", 1), ("b", 2)], "g string, v long")
    expected = sorted(big.join(small, "g", "left").select("k", "g", "v").collect(), key=str)
    joined = lookup(big, small, ["g"], "left")
    assert sorted(joined.select("k", "g", "v").collect(), key=str) == expected
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        beyond = lookup(big, small, ["g"], "left")
        assert "BroadcastHashJoin" not in beyond._jdf.queryExecution().executedPlan().toString()
        assert sorted(beyond.select("k", "g", "v").collect(), key=str) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
