"""Queries on ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import ledgers as L
from assayer.plans.base import fixture, query
from assayer.plans.versions import V_DIGEST

fixture("batches", "SELECT c_custkey AS batch_id FROM {customer}")
fixture("batch_chunks", "SELECT o_custkey AS batch_id, o_orderkey AS index_, CASE o_custkey % 4 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCEEDED' END WHEN 2 THEN CASE o_orderstatus WHEN 'F' THEN 'PAUSED' WHEN 'O' THEN 'QUEUED' ELSE 'SUCCEEDED' END ELSE 'RUNNING' END AS state FROM {orders}")
query("d26_batch_progress", lambda t: L.batch_progress(t.batches, t.batch_chunks).withColumn("progress", F.round("progress", 6)), """
  WITH n AS (SELECT b.batch_id, count(state) AS total, count(*) FILTER (state = 'SUCCEEDED') AS succeeded, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'PAUSED') AS paused, count(*) FILTER (state = 'RUNNING') AS running FROM {batches} b LEFT JOIN {batch_chunks} c USING (batch_id) GROUP BY b.batch_id)
  SELECT *, CASE WHEN total > 0 THEN round((succeeded + failed) / total, 6) ELSE 0 END AS progress, CASE WHEN total = 0 THEN 'PENDING' WHEN succeeded = total THEN 'SUCCEEDED' WHEN failed = total THEN 'FAILED' WHEN succeeded + failed = total THEN 'PARTIAL' WHEN paused > 0 THEN 'PAUSED' WHEN succeeded + failed > 0 OR running > 0 THEN 'RUNNING' ELSE 'PENDING' END AS derived_state FROM n""")
query("d27_batch_result", lambda t: L.batch_result(t.batch_chunks.withColumn("records", F.array(F.col("index_"), F.col("index_") + 1)).withColumnRenamed("index_", "index"), strict=True).select("batch_id", "index", "pos", "record"), """
  WITH w AS (SELECT batch_id FROM {batch_chunks} GROUP BY batch_id HAVING bool_and(state = 'SUCCEEDED')) SELECT batch_id, index_ AS "index", p AS pos, index_ + p AS record FROM {batch_chunks} JOIN w USING (batch_id), (VALUES (0), (1)) AS v(p)""")
fixture("batch_urls", "SELECT o_custkey % 10 AS batch_id, o_orderkey AS seq, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE concat(' https://x/', CAST(o_orderkey % 6000 AS STRING)) END AS url FROM {orders}")
query("e5_chunk_urls", lambda t: L.chunk_urls(t.batch_urls), "SELECT batch_id, url, CAST(floor((row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1) / 100) AS INTEGER) AS chunk FROM (SELECT batch_id, trim(url) AS url, min(seq) AS seq FROM {batch_urls} WHERE trim(url) <> '' GROUP BY ALL)")
fixture("job_ledger", "SELECT o_orderkey AS job_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CASE o_orderkey % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'LEASED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'DEAD_LETTER' ELSE 'SUCCEEDED' END AS state, o_custkey % 5 AS attempts, 3 AS max_attempts, o_orderdate AS created_at, o_orderdate + INTERVAL '10' DAY AS lease_expires_at, o_custkey % 8 AS queue FROM {orders}")
query("d28_queue_ledger_stats", lambda t: L.queue_stats(t.job_ledger), "SELECT state, priority, count(*) AS n FROM {job_ledger} GROUP BY GROUPING SETS ((state), (priority), ())")
query("f4_dead_letters", lambda t: L.dead_letters(t.job_ledger, 25).select("job_id", "created_at"), "SELECT job_id, created_at FROM {job_ledger} WHERE state = 'DEAD_LETTER' ORDER BY created_at DESC, job_id LIMIT 25")
query("f5_lease_order", lambda t: L.lease_order(t.job_ledger).select("queue", "job_id", F.col("place").cast("long").alias("place")), "SELECT queue, job_id, row_number() OVER (PARTITION BY queue ORDER BY priority, created_at, job_id) AS place FROM {job_ledger} WHERE state = 'QUEUED'")
query("i7_expired_leases", lambda t: L.expired_leases(t.job_ledger, F.lit("1998-01-01").cast("timestamp_ntz")).select("job_id", "state", "recovered"), """
  SELECT job_id, CASE WHEN e THEN CASE WHEN attempts >= max_attempts THEN 'DEAD_LETTER' ELSE 'QUEUED' END ELSE state END AS state, e AS recovered FROM (SELECT *, state IN ('LEASED', 'RUNNING') AND lease_expires_at < TIMESTAMP '1998-01-01' AS e FROM {job_ledger})""")
fixture("job_log", "SELECT user_id AS job_id, ts AS at_, event_id AS seq, CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'PLANNING' WHEN 'purchase' THEN 'RUNNING' WHEN 'signup' THEN 'VALIDATING' ELSE 'FAILED' END AS state FROM {events}")
_ALLOWED = " OR ".join(f"(previous = '{a}' AND state IN ({', '.join(f"'{x}'" for x in b.split())}))" for a, b in L.TRANSITIONS.items() if b)
query("e10_job_transition_audit", lambda t: L.job_transitions(t.job_log.withColumnRenamed("at_", "at")).select("seq", "previous", "allowed", "since_start", "terminal"), f"""
  SELECT seq, previous, previous IS NULL OR {_ALLOWED} AS allowed, CAST(floor(epoch(at_)) - floor(epoch(first)) AS BIGINT) AS since_start, state = 'FAILED' AS terminal FROM (SELECT *, lag(state) OVER w AS previous, min(at_) OVER (PARTITION BY job_id) AS first FROM {{job_log}} WINDOW w AS (PARTITION BY job_id ORDER BY at_, seq))""")
fixture("fetch_log", "SELECT event_id AS seq, concat('d', CAST(user_id % 12 AS STRING)) AS domain, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE concat('Prov', CAST(event_id % 3 AS STRING)) END AS provider, CAST(CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 418 WHEN 4 THEN 599 WHEN 5 THEN 299 WHEN 6 THEN 700 WHEN 7 THEN NULL ELSE 404 END AS INT) AS status_code, CASE event_id % 11 WHEN 0 THEN 'Read timed out' WHEN 1 THEN 'HTTP 402 insufficient credits' WHEN 2 THEN 'DNS failure' WHEN 3 THEN 'boom' ELSE '' END AS error, event_id % 5 - 1 AS credits_used FROM {events}")
_KIND = "CASE WHEN error <> '' THEN CASE " + " ".join(f"WHEN regexp_matches(lower(error), '{p}') THEN '{k}'" for p, k in L.ERROR_KINDS) + " ELSE 'provider_failure' END WHEN status_code IS NULL THEN 'network_error' " + " ".join(f"WHEN status_code = {c} THEN '{k}'" for c, k in L.STATUS_KINDS.items()) + " WHEN status_code BETWEEN 200 AND 299 THEN 'ok' WHEN status_code BETWEEN 400 AND 499 THEN 'bad_request' WHEN status_code BETWEEN 500 AND 599 THEN 'server_error' ELSE 'unknown' END"
_FALL = f"k IN ({', '.join(f"'{x}'" for x in L.FALL_THROUGH)})"
query("d33_fetch_health", lambda t: L.fetch_health(t.fetch_log).select("seq", "block_kind", "fall_through"), f"SELECT seq, k AS block_kind, {_FALL} AS fall_through FROM (SELECT seq, {_KIND} AS k FROM {{fetch_log}})")
query("d33_block_rates", lambda t: L.block_rates(t.fetch_log, "domain", "provider").withColumn("block_rate", F.round("block_rate", 6)), f"SELECT domain, provider, count(*) AS fetches, round(avg(CAST({_FALL} AS INTEGER)), 6) AS block_rate FROM (SELECT *, {_KIND} AS k FROM {{fetch_log}}) GROUP BY ALL")
query("d38_provider_credits", lambda t: L.provider_credits(t.fetch_log), "SELECT CASE WHEN trim(provider) = '' THEN 'unknown' ELSE lower(trim(provider)) END AS provider, count(*) AS calls, CAST(sum(greatest(credits_used, 0)) AS BIGINT) AS credits FROM {fetch_log} GROUP BY 1")
fixture("failures", "SELECT event_id AS seq, concat('d', CAST(user_id % 30 AS STRING)) AS domain, CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'HTTP_5XX' WHEN 2 THEN 'NOT_FOUND_404' WHEN 3 THEN 'odd' ELSE 'NETWORK' END AS failure_type, CAST(user_id % 9 AS INT) AS attempts FROM {events} WHERE event_type = 'error'")
query("d34_retry_plan", lambda t: L.retry_plan(t.failures, 8).select("seq", "retry", "attempts_left", "delay_seconds"), """
  SELECT seq, w AND attempts < 8 AS retry, CASE WHEN w THEN greatest(8 - attempts, 0) ELSE 0 END AS attempts_left, CASE WHEN w AND attempts < 8 THEN CASE WHEN attempts < 5 THEN [0.0, 2.0, 4.0, 8.0, 16.0][attempts + 1] ELSE least(60.0, 2.0 * pow(2.0, attempts - 1)) END END AS delay_seconds
  FROM (SELECT *, upper(failure_type) IN ('TIMEOUT', 'HTTP_5XX', 'NETWORK') AS w FROM {failures})""")
query("e9_adaptive_timeouts", lambda t: L.adaptive_timeouts(t.failures).select("seq", "timeout_ms"), "SELECT seq, least(120000, 60000 + 30000 * row_number() OVER (PARTITION BY domain ORDER BY seq)) AS timeout_ms FROM {failures}")
fixture("experiences", """SELECT concat('d', CAST(l_suppkey % 40 AS STRING)) AS domain, CASE WHEN l_orderkey % 4 = 0 THEN 'candidate' ELSE 'baseline' END AS side, CAST(l_quantity AS BIGINT) AS records, 1 - (l_linenumber % 2) / 32e0 AS schema_pass, CASE WHEN l_suppkey % 40 = 3 THEN 1 ELSE 0 END AS flags,
  (l_partkey % 64) / 64e0 - CASE WHEN l_orderkey % 4 = 0 AND l_suppkey % 40 < 10 THEN 1e0 / 16 ELSE 0 END AS completeness, (l_partkey % 16) / 64e0 AS duplicates, CAST(l_partkey % 50 AS BIGINT) + CASE WHEN l_orderkey % 4 = 0 AND l_suppkey % 40 > 30 THEN 20 ELSE 0 END AS cost, CAST(l_orderkey % 30 AS BIGINT) AS latency,
  CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'SELECTOR' ELSE 'BLOCKED' END AS failure_class FROM {lineitem}""")
query("d29_failure_clusters", lambda t: L.failure_clusters(t.experiences), "SELECT domain, failure_class, count(*) AS n FROM {experiences} WHERE failure_class <> '' GROUP BY ALL")
_SIDES = ", ".join(f"avg({c}) FILTER (side = '{s}') AS {s[0]}_{c}" for s in ("baseline", "candidate") for c in ("records", "schema_pass", "completeness", "duplicates", "cost", "latency"))
query("d30_strategy_gate", lambda t: L.strategy_gate(t.experiences), f"""
  SELECT domain, runs, reason = 'passed' AS passed, reason FROM (SELECT domain, runs, CASE WHEN coalesce(c_records, 0) < 1 THEN 'records' WHEN runs < 3 THEN 'runs' WHEN c_schema_pass < 0.95 THEN 'schema' WHEN flags > 0 THEN 'compliance' WHEN c_completeness - b_completeness < -0.02 THEN 'completeness' WHEN c_duplicates - b_duplicates > 0.01 THEN 'duplicates'
    WHEN b_cost > 0 AND c_cost / b_cost > 1.2 THEN 'cost' WHEN b_latency > 0 AND c_latency / b_latency > 1.3 THEN 'latency' ELSE 'passed' END AS reason FROM (SELECT domain, count(*) FILTER (side = 'candidate') AS runs, coalesce(sum(flags) FILTER (side = 'candidate'), 0) AS flags, {_SIDES} FROM {{experiences}} GROUP BY domain))""")
fixture("strategy_runs", "SELECT concat('d', CAST(user_id AS STRING)) AS domain, ts AS at_, event_type <> 'error' AS ok, (event_id % 4) / 4e0 AS quality FROM {events}")
fixture("rollbacks", "SELECT DISTINCT concat('d', CAST(user_id AS STRING)) AS domain, TIMESTAMP '2024-01-27' AS at_ FROM {events} WHERE user_id % 5 = 0")
query("d31_strategy_rollback", lambda t: L.strategy_rollback(t.strategy_runs.withColumnRenamed("at_", "at"), t.rollbacks.withColumnRenamed("at_", "at"), F.lit("2024-01-30").cast("timestamp_ntz")), """
  WITH a AS (SELECT *, (epoch(TIMESTAMP '2024-01-30') - floor(epoch(at_))) / 86400 AS age FROM {strategy_runs}), g AS (SELECT domain, avg(CAST(ok AS INTEGER)) FILTER (age <= 1) AS n, avg(CAST(ok AS INTEGER)) FILTER (age > 1 AND age <= 8) AS b, avg(quality) FILTER (age <= 1) AS q FROM a GROUP BY domain)
  SELECT domain, reason FROM (SELECT domain, CASE WHEN b > 0 AND (b - n) / b > 0.15 THEN 'success rate dropped' WHEN q < 0.5 THEN 'quality below floor' END AS reason FROM g) WHERE reason IS NOT NULL AND domain NOT IN (SELECT domain FROM {rollbacks})""")
fixture("healing", "SELECT event_id % 700 AS run_id, concat('d', CAST(user_id % 20 AS STRING)) AS domain, concat('rung', CAST(event_id % 3 + 1 AS STRING)) AS rung, event_type = 'view' AS recovered, event_id % 6 AS records, event_id % 13 = 0 AS terminal, event_id % 7 <> 0 AS is_extraction FROM {events}")
query("d32_healing_circuit", lambda t: L.healing_circuit(t.healing), "SELECT run_id, domain, count(*) AS attempts, count(*) >= 3 AS tripped FROM {healing} GROUP BY ALL")
query("d39_healing_report", lambda t: L.healing_report(t.healing, {"rung1": 0.0, "rung2": 0.5, "rung3": 0.25}), """
  SELECT domain, rung, count(*) AS attempted, count(*) FILTER (recovered) AS recovered, CAST(sum(records) AS BIGINT) AS records, coalesce(sum(c) FILTER (recovered), sum(c)) AS cost FROM (SELECT *, CASE rung WHEN 'rung2' THEN 0.5 WHEN 'rung3' THEN 0.25 ELSE 0 END AS c FROM {healing} WHERE NOT terminal AND is_extraction) GROUP BY ALL""")
fixture("deliveries", "SELECT event_id % 4000 AS delivery_id, ts AS at_, event_id AS seq, CAST(CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 500 ELSE NULL END AS INT) AS status_code FROM {events}")
query("d40_delivery_status", lambda t: L.delivery_status(t.deliveries.withColumnRenamed("at_", "at")), """
  WITH g AS (SELECT delivery_id, count(*) AS attempts, arg_max(coalesce(status_code, 0), (at_, seq)) AS s, max(at_) AS last FROM {deliveries} GROUP BY 1), d AS (SELECT *, CASE WHEN s BETWEEN 200 AND 299 THEN 'delivered' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status FROM g)
  SELECT delivery_id, attempts, status, CASE WHEN status = 'pending' THEN CAST(floor(epoch(last)) AS BIGINT) + [60, 300, 1800][least(attempts, 3)] END AS next_try_epoch FROM d""")
fixture("audit_log", "SELECT concat('q', CAST(user_id % 25 AS STRING)) AS query, CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' ELSE 'failed' END AS event, ts AS at_, concat('{{\"elapsed\": ', CAST(event_id % 64 AS STRING), '}}') AS details FROM {events}")
query("d41_audit_run_times", lambda t: L.audit_run_times(t.audit_log.withColumnRenamed("at_", "at")).withColumn("mean_elapsed", F.round("mean_elapsed", 6)), """
  SELECT query, count(*) FILTER (event = 'started') AS started, count(*) FILTER (event = 'failed') AS failed, round(avg(CAST(json_extract_string(details, '$.elapsed') AS DOUBLE)) FILTER (event <> 'started'), 6) AS mean_elapsed,
         CAST(floor(epoch(max(at_) FILTER (event <> 'started'))) - floor(epoch(min(at_) FILTER (event = 'started'))) AS BIGINT) AS span_seconds FROM {audit_log} GROUP BY query""")
fixture("run_pages", "SELECT user_id AS run_id, event_id AS page_id, event_type <> 'error' AS ok, event_id % 4 AS records, concat('s', CAST(event_id % 6 AS STRING)) AS source, ts AS at_ FROM {events}")
query("d36_run_receipt", lambda t: L.run_receipt(t.run_pages.withColumnRenamed("at_", "at")), f"""
  SELECT run_id, count(*) AS attempted, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, CAST(sum(records) AS BIGINT) AS records, count(DISTINCT source) AS sources, CAST(floor(epoch(max(at_))) - floor(epoch(min(at_))) AS BIGINT) AS seconds, {V_DIGEST} AS digest
  FROM (SELECT *, sha256(CAST(page_id AS VARCHAR)) AS d FROM {{run_pages}}) GROUP BY run_id""")
fixture("members", "SELECT concat('u', CAST(c_custkey % 50 AS STRING)) AS user_id, c_custkey % 200 AS client_id, CASE c_custkey % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' END AS role FROM {customer}")
query("b4_tenant_scope", lambda t: L.tenant_scope(t.orders.select("o_orderkey", (F.col("o_custkey") % 200).alias("client_id")), t.members, "u7", ("owner", "admin")), "SELECT o_orderkey, o_custkey % 200 AS client_id FROM {orders} WHERE o_custkey % 200 IN (SELECT client_id FROM {members} WHERE user_id = 'u7' AND role IN ('owner', 'admin'))")
