"""The shard reader and row-wise cleaning as Structured Streaming jobs.

The checkpoint folder is the saved state of an epoch: a restarted query continues with the first
shard that was not committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmesh.operators.clean import detokenize_punctuation, filter_quality
from lexmesh.sources.corpus import drop_blank


def stream_shards(spark: SparkSession, folder: str, shards_per_trigger: int = 1) -> DataFrame:
    """Non-blank lines ``(file, line)`` of a folder of shards, a few shards per micro-batch."""
    raw = spark.readStream.option("maxFilesPerTrigger", shards_per_trigger).text(folder)
    return drop_blank(raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")))


def clean_stream(lines: DataFrame) -> DataFrame:
    """The same row-wise filters as the batch job; none of them keeps state."""
    return filter_quality(detokenize_punctuation(lines))


def run_epoch(lines: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process the shards not yet committed and stop; running it again resumes."""
    writer = lines.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
