"""Session set-up and the two ways this package cuts a plan: a bounded table and a checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lexmesh", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "12g")  # one JVM holds all tasks
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """The frame dealt out over ``spark.lexmesh.input.partitions`` partitions, if that is set; as read otherwise.

    For inputs of a few files that Spark cannot split, on a machine with more cores than files.
    """
    wanted = df.sparkSession.conf.get("spark.lexmesh.input.partitions", None)
    return df.repartition(int(wanted)) if wanted else df


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="lexmesh-checkpoint-")
    context.setCheckpointDir(shared)


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """What a write inside shuffles is deleted when it ends; else it stays until the driver collects its garbage."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of any executor."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A result as a table in the shared folder: computed once, and of a size that the planner knows."""
    folder = scratch_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", broadcast_rows: int = 0) -> DataFrame:
    """Equi-join a corpus-sized frame to a per-language, per-file or per-token table.

    The small side is stored first, so its bytes are known: Spark broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle beyond, where adaptive execution splits the
    partitions of a hot key. A small side of up to ``broadcast_rows`` rows is broadcast whatever that threshold is.
    """
    table = stored(small)
    if broadcast_rows and table.count() <= broadcast_rows:
        table = F.broadcast(table)
    return big.join(table, keys, how)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, reachable by every executor."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
