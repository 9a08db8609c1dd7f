"""Dense row numbers, cut points and running values that do not funnel a corpus through one task.

Three shapes occur:

* order by a hash (shuffles, splits): the leading hash digits are uniform, so they bucket the rows
  evenly whatever the group sizes; bucket counts are prefix-summed and only buckets are sorted;
* order by position: one range shuffle, one reliable checkpoint, then per-partition offsets;
* running values inside a file: positions are dense, so ``position div chunk`` is an even bucket.

In each case the table that *is* summed in one place has one row per bucket, not one per line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmesh.functions.hashing import hash_key
from lexmesh.session import cut_lineage, lookup, stored

_HEX_BUCKETS = 1 << 20


def default_buckets(spark: SparkSession) -> int:
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _group(by: Sequence[str]) -> list:
    return list(by) if by else [F.lit(0)]


def _never_null(bucket: Column) -> Column:
    """Keeps Catalyst from adding a null filter, which would compute the bucket a second time."""
    return F.coalesce(bucket, F.lit(0))


def _offsets(df: DataFrame, by: Sequence[str], value: Column, total: str | None) -> DataFrame:
    whole = Window.partitionBy(*_group(by))
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*by, "_bucket").agg(value.alias("_size"))
    columns = [*by, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")]
    if total:
        columns.append(F.sum("_size").over(whole).alias(total))
    return sizes.select(*columns)


def rank_by_hash(df: DataFrame, seed: int | str, key: Sequence[str], by: Sequence[str] = (), name: str = "rank",
                 total: str | None = None, keep: int | None = None, buckets: int | None = None) -> DataFrame:
    """1-based dense rank of each row in the pseudo-random order (md5(seed, key), key) within ``by``.

    ``key`` must identify a row and ``by`` must not hold nulls. ``total`` adds the group size.
    ``keep`` returns only the first rows of every group; whole buckets beyond the cut are dropped
    before the shuffle.
    """
    count = buckets or default_buckets(df.sparkSession)
    digits = F.conv(F.substring("_hash", 1, 5), 16, 10).cast("long")
    hashed = df.withColumn("_hash", hash_key(seed, *key)).withColumn(
        "_bucket", _never_null(F.floor(digits * F.lit(count) / F.lit(_HEX_BUCKETS)).cast("int")))
    offsets = _offsets(hashed, by, F.count(F.lit(1)), total)
    if keep is not None:
        reached = offsets.filter(F.col("_before") < keep)
        if by:
            last = reached.groupBy(*by).agg(F.max("_bucket").alias("_last"))
            hashed = lookup(hashed, last, list(by)).filter(F.col("_bucket") <= F.col("_last")).drop("_last")
        else:
            hashed = hashed.filter(F.col("_bucket") <= reached.agg(F.max("_bucket")).scalar())
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", *key)
    ranked = hashed.withColumn("_inside", F.row_number().over(inside)).join(offsets, [*by, "_bucket"])
    ranked = ranked.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
    if keep is not None:
        ranked = ranked.filter(F.col(name) <= keep)
    return ranked.drop("_hash", "_bucket", "_before", "_inside")


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_no",
                total: str | None = None) -> DataFrame:
    """1-based dense row number in ascending ``order`` within ``by``; the order must be total.

    The rows are range-shuffled, checkpointed with their position in the partition, and shifted by
    per-partition offsets, so no task ever holds a whole group. They are stored first: finding the ranges
    reads them once more, and would compute them a second time.
    """
    sort = list(dict.fromkeys([*by, *order]))
    placed = cut_lineage(stored(df).orderBy(*sort).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_bucket", F.shiftright("_at", 33).cast("int")).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = lookup(placed, _offsets(placed, (), F.count(F.lit(1)), None), ["_bucket"])
    numbered = numbered.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_at", "_bucket", "_before")
    if by or total:
        stats = [F.min(name).alias("_first"), F.count(F.lit(1)).alias(total or "_total")]
        if by:
            numbered = lookup(numbered, numbered.groupBy(*by).agg(*stats), list(by))
        else:
            numbered = numbered.withColumn("_first", F.lit(1)).withColumn(total, F.lit(placed.count()))
        numbered = numbered.withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", "_total")
    return numbered


def head_per_group(df: DataFrame, keep: int, by: str, order: Sequence[str], name: str = "row_no", bins: int = 4096) -> DataFrame:
    """First ``keep`` rows of every group in ``order``; the leading order column must be an integer.

    A histogram of the leading column tells, per group and bin, how many rows come before. Rows of bins that
    cannot matter are dropped before anything is shuffled; the others are ranked inside their bin, so a group
    is never sorted as a whole.
    """
    lead = order[0]
    low, high = df.agg(F.min(lead), F.max(lead)).first()
    if low is None:
        return df.withColumn(name, F.lit(0).cast("long")).filter(F.col(name) > 0)
    width = max(1, -(-(high - low + 1) // bins))
    binned = df.withColumn("_bucket", _never_null(F.floor((F.col(lead) - low) / width).cast("int")))
    reached = _offsets(binned, [by], F.count(F.lit(1)), None).filter(F.col("_before") < keep)
    inside = Window.partitionBy(by, "_bucket").orderBy(*order)
    numbered = lookup(binned, reached, [by, "_bucket"]).withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("long"))
    return numbered.filter(F.col(name) <= keep).drop("_bucket", "_before")


def running(df: DataFrame, by: Sequence[str], position: str, value: Column, name: str, how: str = "sum",
            inclusive: bool = True, total: str | None = None, chunk: int = 1 << 16) -> DataFrame:
    """Running sum or maximum of ``value`` within ``by`` along a dense integer ``position``.

    A file or series of any length is cut into chunks of ``chunk`` positions; chunk totals carry
    over, so a file holding a third of all lines is still spread over many tasks. An exclusive
    value before the first row is null. ``total`` adds the value over all of ``by``.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    cut = df.withColumn("_bucket", _never_null(F.floor(F.col(position) / chunk).cast("long"))).withColumn("_value", value)
    chunks = Window.partitionBy(*_group(by)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = [combine("_size").over(chunks).alias("_before")]
    if total:
        carry.append(combine("_size").over(Window.partitionBy(*_group(by))).alias(total))
    carried = cut.groupBy(*by, "_bucket").agg(combine("_value").alias("_size")).select(*by, "_bucket", *carry)
    inside = Window.partitionBy(*by, "_bucket").orderBy(position).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    joined = cut.withColumn("_inside", combine("_value").over(inside)).join(carried, [*by, "_bucket"])
    if how == "sum":
        both = F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_inside"), F.lit(0))
        merged = F.when(F.col("_before").isNull() & F.col("_inside").isNull(), F.lit(None)).otherwise(both)
    else:
        merged = F.greatest("_before", "_inside")
    return joined.withColumn(name, merged).drop("_bucket", "_value", "_before", "_inside")
