"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from assayer.sources.shared import new_folder, shared_dir

__all__ = ["cleaned", "shared_dir", "stored", "table"]

#: Spark's own switch: shuffle files go when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and returns the table read back.

    Later readers start from files that survive a lost executor; nothing upstream runs twice, so the shuffle files of
    the write can go as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{what}"
    writer = df.write.option("compression", "zstd")
    with cleaned(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
