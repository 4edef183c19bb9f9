"""Streams over the events table, run to the end of what is there (availableNow) into a table that is then read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans.base import query
from assayer.sources.readers import read_usage_stream
from assayer.sources.shared import new_folder
from assayer.streaming import keyed as K
from assayer.streaming import usage as U


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a stream over the files that exist, through a Parquet sink; update mode keeps every version, with its _batch.

    A micro-batch has a folder of its own, which a repeated try overwrites, so no row is there twice.
    """
    spark = stream.sparkSession
    base = new_folder(spark)
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/_batch=-1")  # a stream without rows
    write = lambda df, number: df.write.mode("overwrite").parquet(f"{base}/out/_batch={number}")
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/*").select(*stream.columns, "_batch")


def _events(t) -> DataFrame:
    spark = t.spark
    kind = spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    path = f"{t.sf_dir}/events.parquet"
    stream = spark.readStream.schema(kind).parquet(path if path.endswith("/") else path + "*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


query("i1_dedupe_usage_stream", lambda t: drained(U.dedupe_stream(_events(t).select((F.col("event_id") % 5000).alias("event_id"), F.col("ts").alias("occurred_at")), late="40 days")).select("event_id"), "SELECT DISTINCT event_id % 5000 AS event_id FROM {events}")
query("i2_usage_rollup_stream", lambda t: drained(U.usage_rollup_stream(_events(t).select(F.col("ts").alias("occurred_at"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("client_id"), F.col("event_type").alias("resource_type"), (F.col("event_id") % 9).alias("quantity"), F.lit(1).alias("total_cost_usd")), late="1 hour"), "append").drop("_batch").withColumn("start", F.col("start").cast("date")), """
  SELECT CAST(ts AS DATE) AS start, 'c' || (user_id % 5) AS client_id, event_type AS resource_type, count(*) AS events, CAST(sum(event_id % 9) AS BIGINT) AS quantity, count(*) AS cost_usd FROM {events}
  WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {events}) GROUP BY ALL""")
query("i3_repeated_failures_stream", lambda t: drained(K.repeated_failures_stream(_events(t).select(F.concat(F.lit("t"), "user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "job_failed").otherwise("job_completed").alias("kind")), 86400)).drop("_batch"),
      "SELECT 't' || user_id AS task_id, event_id AS seq, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS recent_failures FROM {events} WHERE event_type = 'error'")
query("i4_alert_cooldown_stream", lambda t: drained(K.alert_cooldown_stream(_events(t).where("event_type = 'error'").select(F.lit("r1").alias("rule_id"), F.concat(F.lit("t"), "user_id").alias("scope_key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.lit(86400).alias("cooldown_seconds")))).select("scope_key", "seq"), """
  WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events} WHERE event_type = 'error'),
  f AS (SELECT user_id, n, event_id, ts AS last, true AS fires FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN o.ts - f.last >= to_seconds(86400) THEN o.ts ELSE f.last END, o.ts - f.last >= to_seconds(86400) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
  SELECT 't' || user_id AS scope_key, event_id AS seq FROM f WHERE fires""")
_ALERTS = lambda t: _events(t).where("event_type in ('error', 'signup')").select(
    F.lit("c").alias("client_id"), F.concat(F.lit("k"), "user_id").alias("dedup_key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "info").when(F.col("event_id") % 3 == 1, "warning").otherwise("critical").alias("severity"),
    F.concat(F.lit("j"), (F.col("event_id") % 7).cast("string")).alias("job_id"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("domain"), (F.col("event_type") == "signup").cast("int").alias("ends"))
_LAST = lambda df: df.groupBy("dedup_key", "number").agg(F.max_by(F.struct("occurrences", "severity", F.array_join("jobs", ",").alias("jobs"), F.array_join("domains", ",").alias("domains"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")), "status"), "_batch").alias("l")).select("dedup_key", "number", "l.*")
query("i5_incident_stream", lambda t: _LAST(drained(K.incident_stream(_ALERTS(t)), "update")), """
  WITH b AS (SELECT user_id, ts, event_id, event_type = 'error' AS hit, coalesce(sum(CAST(event_type = 'signup' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'signup', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM {events} WHERE event_type IN ('error', 'signup')),
  g AS (SELECT user_id, island, count(*) FILTER (hit) AS occurrences, max(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) FILTER (hit) AS rank, string_agg(DISTINCT 'j' || (event_id % 7), ',' ORDER BY 'j' || (event_id % 7)) FILTER (hit) AS jobs, string_agg(DISTINCT 'd' || (event_id % 3), ',' ORDER BY 'd' || (event_id % 3)) FILTER (hit) AS domains,
    min(ts) FILTER (hit) AS started_at, max(ts) FILTER (NOT hit) AS ended_at FROM b GROUP BY ALL)
  SELECT 'k' || user_id AS dedup_key, row_number() OVER (PARTITION BY user_id ORDER BY island) AS number, occurrences, CASE rank WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity, jobs, domains, started_at, ended_at, CASE WHEN ended_at IS NULL THEN 'open' ELSE 'resolved' END AS status FROM g WHERE occurrences > 0""")


def _replayed(t) -> DataFrame:
    """Events, then a third of them once more, through a stream of two micro-batches into a table that keeps ids once."""
    base = new_folder(t.spark)
    rows = t.events.select("event_id", F.col("user_id"), F.col("ts").cast("timestamp").alias("occurred_at"))
    rows.write.parquet(f"{base}/in")
    U.write_once_stream(t.spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows.where("event_id % 3 = 0").write.mode("append").parquet(f"{base}/in")
    U.write_once_stream(t.spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


query("i1_replayed_events", lambda t: _replayed(t).select("event_id", "user_id", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "day"), "SELECT event_id, user_id, ts AS occurred_at, CAST(ts AS DATE) AS day FROM {events}")
query("i6_frontier_stream", lambda t: drained(K.frontier_stream(_events(t).select((F.col("user_id") * 13 + F.col("event_id") % 13).cast("string").alias("url"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("ok"), F.lit(False).alias("blocked"))), "update").groupBy("url").agg(F.max_by("state", "_batch").alias("state"), F.max("attempts").alias("attempts")), """
  WITH n AS (SELECT user_id * 13 + event_id % 13 AS u, event_type = 'view' AS ok, row_number() OVER (PARTITION BY user_id * 13 + event_id % 13 ORDER BY ts, event_id) AS k FROM {events}), g AS (SELECT u, count(*) AS n, min(k) FILTER (ok) AS e FROM n GROUP BY u)
  SELECT CAST(u AS VARCHAR) AS url, CASE WHEN e <= 3 THEN 'PROCESSED' WHEN n >= 3 THEN 'FAILED' ELSE 'RETRY_WAIT' END AS state, least(3, n, coalesce(e, 3)) AS attempts FROM g""")


def _usage_files(t) -> DataFrame:
    path = f"{new_folder(t.spark)}/usage"
    rows = t.events.select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("client_id"), F.col("event_type").alias("resource_type"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 9).alias("quantity"), F.col("ts").cast("timestamp").alias("occurred_at"))
    rows.write.option("ignoreNullFields", "true").json(path)
    return read_usage_stream(t.spark, path)


query("a6_read_usage_stream", lambda t: drained(_usage_files(t)).select("event_id", "client_id", F.col("quantity").cast("long").alias("quantity"), "metadata"), "SELECT CAST(event_id AS VARCHAR) AS event_id, 'c' || (user_id % 5) AS client_id, CASE WHEN event_id % 4 > 0 THEN event_id % 9 ELSE 0 END AS quantity, chr(123) || chr(125) AS metadata FROM {events}")
