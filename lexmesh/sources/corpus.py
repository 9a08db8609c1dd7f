"""Line corpora: text files, language collections and web records, always with their position."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmesh.functions.text import BLANK, physical_lines, strip
from lexmesh.session import lookup


def read_records(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """Text files as ``(file, record_no, value)`` with 1-based positions, without shuffling the text.

    Inside one file split rows arrive in file order with consecutive ids, so a table with one row
    per split (its first id and the records before it) is enough to number every record.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        "file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = lookup(rows, blocks, ["file", "_block"])
    return placed.select("file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("record_no"), "value")


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stripped, non-blank lines ``(file, line_no, line)``; ``line_no`` is the physical line."""
    return drop_blank(read_records(spark, paths).select("file", F.col("record_no").alias("line_no"), F.col("value").alias("line")))


def drop_blank(lines: DataFrame) -> DataFrame:
    # a filter on the stripped line would strip every line twice
    return lines.filter(F.col("line").rlike(rf"(?U)[^{BLANK[1:-1]}]")).withColumn("line", strip(F.col("line")))


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files under a path, by name, spelt as in the ``file`` column: Spark writes one or three slashes behind ``file:``."""
    return sorted(re.sub(r"^file:/+", "file:/", file) for file in spark.read.text(path).inputFiles())


def _by_file(lines: DataFrame, table: DataFrame) -> DataFrame:
    named = table.withColumnRenamed("file", "_file")
    return lookup(lines.withColumn("_file", F.regexp_replace("file", "^file:/+", "file:/")), named, ["_file"]).drop("_file")


def scan_language_files(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """A language collection (language -> files) as lines tagged ``lang``: all files are read at once."""
    named = [(lang, file) for lang, paths in files.items() for path in paths for file in _files(spark, path)]
    table = spark.createDataFrame(named, "lang string, file string")
    return _by_file(scan_lines(spark, [p for paths in files.values() for p in paths]), table)


def with_input_order(lines: DataFrame, paths: list[str]) -> DataFrame:
    """Add ``input_no``, the place of the line's file among ``paths`` (a folder's files by name)."""
    spark = lines.sparkSession
    named = [(file, i) for i, path in enumerate(paths) for file in _files(spark, path)]
    order = spark.createDataFrame([(file, i) for i, (file, _) in enumerate(named)], "file string, input_no long")
    return _by_file(lines, order)


def attach_language(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Tag lines with the language a ``(lang, file)`` table assigns to their file."""
    return lookup(lines, files.select("file", "lang"), ["file"])


def explode_records(records: DataFrame, text: str = "text") -> DataFrame:
    """Web records to one row per physical line, blank lines included."""
    others = [c for c in records.columns if c != text]
    exploded = records.select(*others, F.posexplode(physical_lines(F.col(text))).alias("_pos", "line"))
    return exploded.select(*others, (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def record_lines(records: DataFrame, text: str = "text") -> DataFrame:
    """``explode_records`` followed by the strip-and-drop rule of every line reader."""
    return drop_blank(explode_records(records, text))
