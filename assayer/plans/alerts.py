"""Queries on alerts, incidents and service levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import alerts as A
from assayer.plans.base import fixture, query

fixture("alert_runs", """
  SELECT event_id AS seq, ts AS at_, event_type <> 'error' AS ok, concat('c', CAST(user_id % 5 AS STRING)) AS client_id, concat('t', CAST(user_id AS STRING)) AS task_id, concat('j', CAST(event_id % 300 AS STRING)) AS job_id, concat('d', CAST(user_id % 9 AS STRING)) AS domain,
         (event_id % 100) / 128e0 AS quality_score, (user_id % 50) / 64e0 AS confidence_mean, event_id % 40 AS records, event_id % 6 AS conflicts FROM {events}""")
_RULES = [("r1", "client", "", "job_failed", None, "critical", 3600, True), ("r2", "client", "c1", "quality_below", 0.2, "warning", 7200, True), ("r3", "task", "t7", "record_count_drop", 20, "warning", 0, True), ("r4", "domain", "d3", "record_count_rise", 35, "info", 86400, True),
          ("r5", "client", "", "source_conflict_spike", 5, "warning", 43200, True), ("r6", "job", "j5", "confidence_collapse", 0.5, "info", 60, True), ("r7", "client", "", "repeated_job_failure", 2, "critical", 600, True), ("r8", "client", "", "job_failed", None, "info", 0, False)]
fixture("alert_rules", " UNION ALL ".join(
    f"SELECT '{r[0]}' AS rule_id, '{r[1]}' AS scope, '{r[2]}' AS scope_id, '{r[3]}' AS condition_type, CAST({'NULL' if r[4] is None else r[4]} AS DOUBLE) AS threshold, '{r[5]}' AS severity, {r[6]} AS cooldown_seconds, {str(r[7]).lower()} AS enabled FROM {{region}} WHERE r_regionkey = 0" for r in _RULES))


def _events(t):
    return A.with_recent_failures(A.run_alert_events(t.alert_runs.withColumnRenamed("at_", "at")), 86400)


def _matches(t):
    return A.match_rules(_events(t), t.alert_rules)


_MATCH = """
  ev AS (SELECT *, CASE WHEN ok THEN 'job_completed' ELSE 'job_failed' END AS kind, CASE WHEN NOT ok THEN count(*) FILTER (NOT ok) OVER (PARTITION BY task_id ORDER BY at_ RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) END AS recent FROM {alert_runs}),
  pairs AS (SELECT e.*, r.rule_id, r.severity, r.cooldown_seconds, r.condition_type FROM ev e JOIN {alert_rules} r ON r.enabled AND (r.scope <> 'client' OR r.scope_id = '' OR r.scope_id = e.client_id) AND (r.scope <> 'task' OR r.scope_id = e.task_id) AND (r.scope <> 'job' OR r.scope_id = e.job_id) AND (r.scope <> 'domain' OR r.scope_id = e.domain)
    AND CASE r.condition_type WHEN 'job_failed' THEN NOT ok WHEN 'repeated_job_failure' THEN NOT ok AND recent >= threshold WHEN 'quality_below' THEN ok AND quality_score < threshold WHEN 'confidence_collapse' THEN ok AND confidence_mean < threshold
        WHEN 'record_count_drop' THEN ok AND records < threshold WHEN 'record_count_rise' THEN ok AND records > threshold WHEN 'source_conflict_spike' THEN ok AND conflicts >= threshold END)"""
_KEY = "substr(sha256(rule_id || '|' || kind || '|' || task_id || '|' || job_id || '|' || domain), 1, 16)"
query("b15_run_alert_events", lambda t: A.run_alert_events(t.alert_runs.withColumnRenamed("at_", "at")).select("seq", "kind", "client_id", F.get_json_object("payload", "$.records").cast("long").alias("records")),
      "SELECT seq, CASE WHEN ok THEN 'job_completed' ELSE 'job_failed' END AS kind, client_id, records FROM {alert_runs}")
query("i3_repeated_failures", lambda t: _events(t).where("recent_failures >= 2").select("seq", "task_id", "recent_failures"), f"WITH {_MATCH} SELECT seq, task_id, recent AS recent_failures FROM ev WHERE recent >= 2")
query("c9_match_rules", lambda t: _matches(t).select("seq", "rule_id", "severity", "scope_key", "dedup_key"), f"WITH {_MATCH} SELECT seq, rule_id, severity, task_id AS scope_key, {_KEY} AS dedup_key FROM pairs")
query("c9_alert_messages", lambda t: _matches(t).select("seq", "rule_id", "message"), f"""
  WITH {_MATCH} SELECT seq, rule_id, CASE condition_type WHEN 'job_failed' THEN 'job ' || job_id || ' failed' WHEN 'quality_below' THEN printf('quality score %.2f below threshold 0.20', quality_score) WHEN 'confidence_collapse' THEN printf('mean confidence %.2f below threshold 0.50', confidence_mean)
    WHEN 'record_count_drop' THEN 'record count ' || records || ' below threshold 20' WHEN 'record_count_rise' THEN 'record count ' || records || ' above threshold 35' WHEN 'source_conflict_spike' THEN 'source conflicts ' || conflicts || ' met/exceeded 5' ELSE recent || ' failures in window (threshold 2)' END AS message FROM pairs""")
_FIRED = f"""{_MATCH},
  ordered AS (SELECT *, row_number() OVER (PARTITION BY rule_id, task_id ORDER BY at_, seq) AS n FROM pairs),
  fold AS (SELECT rule_id, task_id, n, seq, at_ AS last, true AS fires FROM ordered WHERE n = 1
    UNION ALL SELECT o.rule_id, o.task_id, o.n, o.seq, CASE WHEN o.cooldown_seconds <= 0 OR o.at_ - f.last >= to_seconds(o.cooldown_seconds) THEN o.at_ ELSE f.last END, o.cooldown_seconds <= 0 OR o.at_ - f.last >= to_seconds(o.cooldown_seconds)
    FROM fold f JOIN ordered o ON o.rule_id = f.rule_id AND o.task_id = f.task_id AND o.n = f.n + 1)"""
query("i4_alert_cooldown", lambda t: A.alert_cooldown(_matches(t)).select("seq", "rule_id", "scope_key"), f"WITH RECURSIVE {_FIRED} SELECT seq, rule_id, task_id AS scope_key FROM fold WHERE fires")

fixture("fired_alerts", "SELECT event_id AS alert_id, concat('c', CAST(user_id % 5 AS STRING)) AS client_id, CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity, CASE event_id % 5 WHEN 0 THEN 'k1' WHEN 1 THEN 'mail' WHEN 2 THEN 'c2' WHEN 3 THEN 'ghost' ELSE NULL END AS target FROM {events} WHERE event_type = 'error'")
fixture("connectors", "SELECT concat('k', CAST(n_nationkey AS STRING)) AS connector_id, CASE n_nationkey % 3 WHEN 0 THEN 'mail' WHEN 1 THEN 'chat' ELSE 'file' END AS type, concat('c', CAST(n_nationkey % 5 AS STRING)) AS client_id, CASE n_nationkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' ELSE 'warning' END AS min_severity, n_nationkey % 3 <> 2 AS notifies FROM {nation}")
_RANK = "list_position(['info', 'warning', 'critical'], {c})"
query("c8_route_alerts", lambda t: A.route_alerts(t.fired_alerts.withColumn("targets", F.when(F.col("target").isNotNull(), F.array("target"))), t.connectors), f"""
  WITH hits AS (SELECT a.*, k.connector_id, k.min_severity, CASE WHEN a.target IS NULL THEN 3 WHEN k.client_id = a.client_id AND k.connector_id = a.target THEN 0 WHEN k.client_id = a.client_id AND k.type = a.target THEN 1 WHEN k.client_id = a.target THEN 2 END AS how
    FROM {{fired_alerts}} a JOIN {{connectors}} k ON (a.target IS NULL AND k.client_id = a.client_id AND k.notifies) OR (k.client_id = a.client_id AND (k.connector_id = a.target OR k.type = a.target)) OR k.client_id = a.target),
  best AS (SELECT *, min(how) OVER (PARTITION BY alert_id, target) AS b FROM hits)
  SELECT alert_id, coalesce(target, '') AS target, connector_id, NULL AS error FROM best WHERE how = b AND {_RANK.format(c='severity')} >= {_RANK.format(c='min_severity')}
  UNION ALL SELECT alert_id, target, NULL, 'unresolved target' FROM {{fired_alerts}} WHERE target IS NOT NULL AND alert_id NOT IN (SELECT alert_id FROM hits)""")

fixture("incident_alerts", "SELECT event_id AS seq, ts AS at_, concat('c', CAST(user_id % 5 AS STRING)) AS client_id, concat('k', CAST(user_id AS STRING)) AS dedup_key, CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity, concat('j', CAST(event_id % 30 AS STRING)) AS job_id, concat('d', CAST(event_id % 4 AS STRING)) AS domain FROM {events} WHERE event_type = 'error'")
fixture("incident_endings", "SELECT concat('c', CAST(user_id % 5 AS STRING)) AS client_id, concat('k', CAST(user_id AS STRING)) AS dedup_key, ts AS at_ FROM {events} WHERE event_type = 'signup' AND event_id % 4 = 0")
query("i5_incidents", lambda t: A.incidents(t.incident_alerts.withColumnRenamed("at_", "at"), t.incident_endings.withColumnRenamed("at_", "at")).select("client_id", "dedup_key", F.col("number").cast("long").alias("number"), "occurrences", "severity", F.array_join("jobs", ",").alias("jobs"), F.array_join("domains", ",").alias("domains"), "started_at", "ended_at"), """
  WITH both_ AS (SELECT client_id, dedup_key, at_, seq, list_position(['info', 'warning', 'critical'], severity) AS rank, job_id, domain, 0 AS ends FROM {incident_alerts} UNION ALL SELECT client_id, dedup_key, at_, 0, 0, NULL, NULL, 1 FROM {incident_endings}),
  islands AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY client_id, dedup_key ORDER BY at_, ends, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM both_),
  g AS (SELECT client_id, dedup_key, island, count(*) FILTER (ends = 0) AS occurrences, max(rank) AS rank, string_agg(DISTINCT job_id, ',' ORDER BY job_id) AS jobs, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, min(at_) FILTER (ends = 0) AS started_at, max(at_) FILTER (ends = 1) AS ended_at FROM islands GROUP BY ALL)
  SELECT client_id, dedup_key, row_number() OVER (PARTITION BY client_id, dedup_key ORDER BY island) AS number, occurrences, ['info', 'warning', 'critical'][rank] AS severity, jobs, domains, started_at, ended_at FROM g WHERE occurrences > 0""")
fixture("incident_table", "SELECT o_orderkey AS incident_id, concat('c', CAST(o_custkey % 5 AS STRING)) AS client_id, CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'O' THEN 'acknowledged' ELSE 'resolved' END AS status, concat('j', CAST(o_custkey AS STRING)) AS job_a, concat('j', CAST(o_custkey + 1 AS STRING)) AS job_b, CASE o_orderkey % 3 WHEN 0 THEN 'schema_change' WHEN 1 THEN 'budget_threshold' ELSE 'other' END AS condition_type, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL '3' DAY END AS ended_at FROM {orders}")
fixture("succeeded_jobs", "SELECT concat('j', CAST(c_custkey AS STRING)) AS job_id FROM {customer} WHERE c_custkey % 10 = 0")
query("c11_resolve_incidents", lambda t: A.resolve_incidents(t.incident_table.withColumn("jobs", F.array("job_a", "job_b")), t.succeeded_jobs).select("incident_id", "status"),
      "SELECT incident_id, CASE WHEN status <> 'resolved' AND (job_a IN (SELECT job_id FROM {succeeded_jobs}) OR job_b IN (SELECT job_id FROM {succeeded_jobs})) THEN 'resolved' ELSE status END AS status FROM {incident_table}")
query("d24_incident_report", lambda t: A.incident_report(t.incident_table, F.lit("2002-01-01").cast("timestamp_ntz"), 50).select("client_id", "incident_id", F.col("place").cast("long").alias("place"), "duration_seconds", "failure_class", "open"), """
  SELECT client_id, incident_id, place, CAST(epoch(coalesce(ended_at, TIMESTAMP '2002-01-01')) - epoch(started_at) AS BIGINT) AS duration_seconds, CASE condition_type WHEN 'schema_change' THEN 'schema' WHEN 'budget_threshold' THEN 'budget' ELSE 'unknown' END AS failure_class, ended_at IS NULL AS open
  FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY started_at DESC, incident_id) AS place FROM {incident_table}) WHERE place <= 50""")
fixture("slos", "SELECT event_type AS slo_id, CASE WHEN event_type IN ('view', 'click') THEN 'above' ELSE 'below' END AS direction, CASE event_type WHEN 'view' THEN 99e0 WHEN 'click' THEN 40e0 ELSE 60e0 END AS target, CASE WHEN event_type = 'error' THEN 1 ELSE 7 END AS window_days, 100 AS min_samples, event_type <> 'signup' AS enabled FROM {events} GROUP BY event_type")
fixture("slo_samples", "SELECT event_type AS slo_id, CAST(round(value) AS BIGINT) AS value, ts AS sampled_at FROM {events}")
query("d23_slo_status", lambda t: A.slo_status(t.slos, t.slo_samples, F.lit("2024-01-30").cast("timestamp_ntz")).withColumns({"mean": F.round("mean", 6), "margin": F.round("margin", 6)}), """
  WITH m AS (SELECT s.slo_id, any_value(direction) AS direction, any_value(target) AS target, any_value(min_samples) AS min_samples, any_value(enabled) AS enabled, count(value) AS n, avg(value) AS mean
    FROM {slos} s LEFT JOIN {slo_samples} v ON v.slo_id = s.slo_id AND sampled_at <= TIMESTAMP '2024-01-30' AND sampled_at >= TIMESTAMP '2024-01-30' - to_days(window_days) GROUP BY s.slo_id),
  g AS (SELECT *, CASE WHEN direction = 'above' THEN mean - target ELSE target - mean END AS gap FROM m)
  SELECT slo_id, n, round(mean, 6) AS mean, CASE WHEN NOT enabled THEN 'DISABLED' WHEN n < min_samples THEN 'INSUFFICIENT' WHEN gap < 0 THEN 'BREACHED' WHEN gap < abs(target) * 0.1 THEN 'AT_RISK' ELSE 'MEETING' END AS status, round(gap, 6) AS margin FROM g""")
