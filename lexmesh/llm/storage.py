"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.session import scratch_folder, shuffles_cleaned


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder: computed once, read again after the loss of any executor.

    What was shuffled for it goes as soon as it is written; else it stays until the driver collects its garbage.
    """
    spark, folder = df.sparkSession, scratch_folder(df.sparkSession, name)
    with shuffles_cleaned(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more. What was made of them has to be written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of long texts in thousands of rows, not tens of thousands: a worker holds one batch and what it makes of it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose (doc_id, row) is not in ``gone``; ``row`` is a hash of the text.

    What goes is written first: Spark then knows its size and moves the texts only if it is too large to send around.
    """
    gone = written(gone.select(F.col("doc_id").alias("id"), F.col("row").alias("hash")).distinct(), name)
    return docs.join(gone, (F.xxhash64(docs["text"].cast("string")) == gone["hash"]) & docs["doc_id"].eqNullSafe(gone["id"]), "left_anti")
