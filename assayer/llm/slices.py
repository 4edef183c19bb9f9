"""Ranks within a key that may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, key: str, unique: list[str], salts: int) -> DataFrame:
    """rows with rank: 0, 1, ... within key, in an order fixed by the unique columns, which no two rows of a key share.

    A key that holds most rows is counted and ranked in `salts` slices by a hash of the unique columns; their counts give
    each its first rank. A null key is a key of its own.
    """
    slice_ = F.pmod(F.xxhash64(*unique), F.lit(salts)).cast("int")
    rows = rows.withColumn("slice", slice_)
    starts = rows.groupBy(key, "slice").agg(F.count("*").alias("n")).select(
        F.col(key).alias("_key"), F.col("slice").alias("_slice"),
        (F.sum("n").over(Window.partitionBy(key).orderBy("slice")) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy(key, "slice").orderBy(*unique)) - 1
    joined = rows.withColumn("inside", inside).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice")))
    return joined.withColumn("rank", F.col("first") + F.col("inside")).drop("slice", "inside", "first", "_key", "_slice")
