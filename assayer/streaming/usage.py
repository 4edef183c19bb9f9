"""Usage events as a stream: each once, and windowed sums."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def dedupe_stream(events: DataFrame, key: str = "event_id", at: str = "occurred_at", late: str = "1 hour") -> DataFrame:
    """Each id once; ids are forgotten when the watermark passes them, so state is bounded by `late`."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def append_once(batch: DataFrame, target: str, key: str = "event_id", at: str = "occurred_at", anywhere: bool = False) -> None:
    """Appends the rows of a batch whose id the table at target does not hold yet, however long ago it came; of equal ids the earliest.

    The table is partitioned by the day of `at` and its files carry Bloom filters on the id. A replayed event tells its own
    time again, so ids are looked for among the days of the batch; anywhere: among all days, for sources that stamp replays
    anew. A batch that is tried again finds its own rows and adds none. One writer per table at a time.
    """
    spark = batch.sparkSession
    first = F.min_by(F.struct(*batch.columns), F.struct(F.col(at).isNull(), F.col(at)))
    fresh = batch.groupBy(F.col(key).alias("_id")).agg(first.alias("r")).select("r.*").withColumn("day", F.to_date(at))
    try:
        known = spark.read.schema(fresh.schema).parquet(target)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], fresh.schema)
    if not anywhere:
        days = [r.day for r in fresh.select("day").distinct().collect()]  # the days of one micro-batch
        known = known.where(F.col("day").isin(*(d for d in days if d is not None)) | (F.lit(None in days) & F.col("day").isNull()))
    rows = fresh.join(known.select(F.col(key).alias("_known")), F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    rows.write.mode("append").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("day").parquet(target)


def write_once_stream(events: DataFrame, target: str, checkpoint: str, key: str = "event_id", at: str = "occurred_at", anywhere: bool = False) -> DataStreamWriter:
    """A writer (to be started) that keeps every id once in the table at target, without a watermark: nothing is forgotten, no state grows."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_once(batch, target, key, at, anywhere))


def usage_rollup_stream(events: DataFrame, window: str = "1 day", at: str = "occurred_at", late: str = "1 hour") -> DataFrame:
    """(start, client_id, resource_type, events, quantity, cost_usd) per window; rows behind the watermark are dropped."""
    sums = [F.count("*").alias("events"), F.sum("quantity").alias("quantity"), F.sum("total_cost_usd").alias("cost_usd")]
    rolled = events.withWatermark(at, late).groupBy(F.window(at, window), "client_id", "resource_type").agg(*sums)
    return rolled.select(F.col("window.start").alias("start"), "client_id", "resource_type", "events", "quantity", "cost_usd")
