"""Places and running sums within a key, for keys that may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.sources.shared import shared_dir


def in_parts(df: DataFrame, key: str, order: list[Column], sums: dict[str, str | Column]) -> tuple[DataFrame, DataFrame]:
    """(dealt, totals): df range-partitioned by key and order with its partition _part, checkpointed; and per (_key, _in) of a
    key and a partition, for every entry of sums, before_<name> (what earlier partitions add up to) and own_<name>.

    order must be total within a key. totals has a row per key of each partition; no key is sorted or summed in one task.
    """
    spark = df.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, F.asc_nulls_last(key), *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    each = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_in")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"own_{n}") for n, c in sums.items()))
    before = Window.partitionBy("_key").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, each.withColumns({f"before_{n}": F.coalesce(F.sum(f"own_{n}").over(before), F.lit(0)) for n in sums})


def with_totals(dealt: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    return dealt.join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in"))).drop("_key", "_in")


def numbered(df: DataFrame, key: str, order: list[Column], place: str = "place", sums: dict[str, str] | None = None) -> DataFrame:
    """df with place (1, 2, ... within key) and, per entry of sums (new column: summed column), the sum up to and with the row.

    order must be total within a key. Rows are range-partitioned by key and order and checkpointed; every partition's totals
    give the next its start, so no key is sorted in one task. A null key is a key of its own.
    """
    columns = {place: F.lit(1), **(sums or {})}
    dealt, totals = in_parts(df, key, order, columns)
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in columns.items()}
    joined = with_totals(dealt.withColumns(own), totals.drop(*(f"own_{n}" for n in columns)), key)
    return joined.withColumns({n: F.col(n) + F.col(f"before_{n}") for n in columns}).drop("_part", *(f"before_{n}" for n in columns))


def until_limits(df: DataFrame, key: str, order: list[Column], limits: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """The rows of each key, in order, before which no running sum has reached its limit; limits: name to (summed column, limit).

    The totals of partitions tell which lie wholly before a limit, which behind it, and in which one it is reached; only those
    last ones are scanned in order. Summed values must not be negative; nulls count as zero.
    """
    dealt, totals = in_parts(df, key, order, {n: c for n, (c, _) in limits.items()})
    every = lambda value: reduce(lambda x, y: x & y, [value(n) < limit for n, (_, limit) in limits.items()])
    parts = with_totals(dealt, totals.where(every(lambda n: F.col(f"before_{n}"))), key)
    whole = every(lambda n: F.col(f"before_{n}") + F.col(f"own_{n}"))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = parts.where(~whole).withColumns({f"own_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, (c, _) in limits.items()}).where(whole)
    return parts.where(whole).select(*df.columns).unionAll(scanned.select(*df.columns))
