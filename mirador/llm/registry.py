"""The named queries of this subpackage and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirador.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rows of an Arrow batch: texts are long.
BATCH_ROWS = "1000"


def prepared(spark: SparkSession) -> SparkSession:
    """The library's session settings, with batches that fit texts of some kilobytes."""
    spark = tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def query(name: str, sql: str | None = None):
    """Register ``build(spark, folder)`` under a query key."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepared(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
