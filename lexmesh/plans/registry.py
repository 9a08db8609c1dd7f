"""Named queries over the test tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def _plain_types(df: DataFrame) -> DataFrame:
    wider = {T.IntegerType(): "long", T.ShortType(): "long", T.FloatType(): "double"}
    return df.select(*[F.col(f.name).cast(wider[f.dataType]).alias(f.name) if f.dataType in wider else F.col(f.name)
                       for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: _plain_types(build(Tables(spark, folder)))
        if sql:
            ORACLES[name] = sql
        return build
    return register
