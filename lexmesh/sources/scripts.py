"""Unicode script lookup: the JVM's own table by default, or a Scripts.txt-style file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNLISTED = "UNK"

# Fixed value: the one script whose published name is not "first letter of each part upper case".
_IRREGULAR = {"Signwriting": "SignWriting"}


def jvm_script(codepoint: Column) -> Column:
    """Script of a code point under the names used by Scripts.txt; unlisted ones are ``UNK``."""
    raw = F.java_method(F.lit("java.lang.Character$UnicodeScript"), F.lit("of"), codepoint.cast("int"))
    name = F.replace(F.initcap(F.replace(F.lower(raw), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))
    for given, published in _IRREGULAR.items():
        name = F.when(name == given, F.lit(published)).otherwise(name)
    return F.when(raw == "UNKNOWN", F.lit(UNLISTED)).otherwise(name)


def unicode_script_ranges(spark: SparkSession) -> DataFrame:
    """All listed code points as ``(cp_from, cp_to, script)``, built from the JVM's Unicode data."""
    points = spark.range(0x110000).select(F.col("id").cast("int").alias("cp"), jvm_script(F.col("id")).alias("script"))
    listed = points.filter(F.col("script") != UNLISTED)
    island = F.col("cp") - F.row_number().over(Window.partitionBy("script").orderBy("cp"))
    return (listed.withColumn("island", island).groupBy("script", "island")
            .agg(F.min("cp").alias("cp_from"), F.max("cp").alias("cp_to")).select("cp_from", "cp_to", "script"))


def read_script_table(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``HEX[..HEX] ; Script # comment`` as ``(cp_from, cp_to, script)``."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    fields = F.split(F.trim("value"), r"\s+")
    bounds = F.split(F.get(fields, F.lit(0)), r"\.\.")
    return rows.select(F.conv(F.get(bounds, F.lit(0)), 16, 10).cast("int").alias("cp_from"),
                       F.conv(F.element_at(bounds, -1), 16, 10).cast("int").alias("cp_to"),
                       F.get(fields, F.lit(2)).alias("script"))


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges to one row per code point: at most 0x110000 rows, whatever the data."""
    return ranges.select(F.explode(F.sequence("cp_from", "cp_to")).alias("cp"), "script")
