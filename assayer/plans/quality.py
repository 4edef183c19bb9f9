"""Queries on quality rules, anomalies and the publication gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.text import EMAIL
from assayer.operators import quality as Q
from assayer.plans.base import fixture, query

fixture("graded", """
  SELECT event_id AS seq, concat('item ', CAST(event_id % 7000 AS STRING)) AS title, CASE WHEN event_id % 8 = 0 THEN '' WHEN event_id % 8 = 1 THEN 'n/a' ELSE concat('$', CAST(user_id AS STRING), '.5') END AS price,
         CASE WHEN event_id % 5 = 0 THEN 'nobody' ELSE concat('u', CAST(user_id AS STRING), '@x.example') END AS email, CAST(user_id * 3 AS STRING) AS score,
         CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 50 = 1 THEN 'soon' ELSE concat('2024-01-', lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0'), 'T00:00:00') END AS seen FROM {events}""")
_RULES = Q.QualityRules(min_records=100, required_fields=["title", "price"], field_types={"price": "currency", "email": "email"}, numeric_bounds={"score": (0, 400)}, failed_page_count=2, total_page_count=20, empty_page_count=1,
                        source_disagreement_rate=0.1, freshness_window_seconds=20 * 86400, freshness_fields=["seen"], min_freshness_rate=0.5)
_NOW = "2024-01-30 00:00:00"
_BADP, _BADE = f"price <> '' AND NOT regexp_matches(price, '{Q.CURRENCY}')", f"email <> '' AND NOT regexp_matches(email, '{EMAIL}')"
_AGE = f"epoch(TIMESTAMP '{_NOW}') - epoch(TRY_CAST(seen AS TIMESTAMP)) <= {20 * 86400}"
_REPORT = f"""
  n AS (SELECT count(*) AS n, (count(*) FILTER (title <> '') + count(*) FILTER (price <> '') + count(*) FILTER (email <> '') + count(*) FILTER (score <> '') + count(*) FILTER (seen <> '') + count(seq)) / (6.0 * count(*)) AS populated,
    count(*) FILTER (title = '') + count(*) FILTER (price = '') AS required, count(*) FILTER ({_BADP}) + count(*) FILTER ({_BADE}) AS types, count(*) FILTER (NOT CAST(score AS DOUBLE) BETWEEN 0 AND 400) AS bounds,
    count(*) FILTER ({_AGE}) AS fresh, count(*) FILTER (seen = '') AS missing, count(*) FILTER (seen <> '' AND TRY_CAST(seen AS TIMESTAMP) IS NULL) AS unparseable, count(*) - count(DISTINCT title) AS extra FROM {{graded}}),
  report AS (
    SELECT 'min_records' AS rule, n >= 100 AS passed, CAST(n AS DOUBLE) AS value FROM n UNION ALL SELECT 'max_failed_page_pct', true, 0.1 UNION ALL SELECT 'max_empty_page_pct', true, 0.05
    UNION ALL SELECT 'min_populated_field_pct', populated >= 0.5, populated FROM n UNION ALL SELECT 'required_fields', required = 0, required FROM n UNION ALL SELECT 'type_validity', types = 0, types FROM n
    UNION ALL SELECT 'range_validity', bounds = 0, bounds FROM n UNION ALL SELECT 'duplicate_rate', extra / n <= 0.2, extra / n FROM n UNION ALL SELECT 'source_disagreement', true, 0.1
    UNION ALL SELECT 'freshness', fresh / n >= 0.5 AND missing = 0 AND unparseable = 0, fresh / n FROM n),
  verdict AS (SELECT bool_and(passed) AS passed, avg(CAST(passed AS INTEGER)) AS score, string_agg(rule, ',' ORDER BY rule) FILTER (NOT passed) AS failed_rules, bool_or(NOT passed AND rule LIKE 'max%page%') AS pages FROM report)"""


def _report(t):
    return Q.quality_report(t.graded, _RULES, F.lit(_NOW).cast("timestamp"))


query("d9_quality_report", lambda t: _report(t).withColumn("value", F.round("value", 6)), f"WITH {_REPORT} SELECT rule, passed, round(value, 6) AS value FROM report")
query("d9_quality_verdict", lambda t: Q.quality_verdict(_report(t)).select("passed", F.round("score", 6).alias("score"), F.array_join("failed_rules", ",").alias("failed_rules"), "action"),
      f"WITH {_REPORT} SELECT passed, round(score, 6) AS score, failed_rules, CASE WHEN passed THEN 'publish' WHEN pages THEN 'retry' WHEN score < 0.5 THEN 'escalate' ELSE 'quarantine' END AS action FROM verdict")
query("d10_freshness_rate", lambda t: Q.freshness(t.graded, ["seen"], 20 * 86400, F.lit(_NOW).cast("timestamp")), f"WITH {_REPORT} SELECT n AS total, fresh, missing, unparseable FROM n")
_listed = lambda rows, condition, column: f"(SELECT string_agg(seq || '=' || {column}, ', ' ORDER BY seq) FROM (SELECT seq, {column} FROM {{{rows}}} WHERE {condition} ORDER BY seq LIMIT 3))"
query("b13_samples", lambda t: Q.check_types(t.graded, {"price": "currency", "email": "email", "title": "text"}, "seq").select("field", "violations", F.array_join(F.transform("samples", lambda s: F.concat_ws("=", s["key"].cast("string"), s["value"])), ", ").alias("samples")), f"""
  SELECT 'price' AS field, count(*) AS violations, {_listed('graded', _BADP, 'price')} AS samples FROM {{graded}} WHERE {_BADP} UNION ALL SELECT 'email', count(*), {_listed('graded', _BADE, 'email')} FROM {{graded}} WHERE {_BADE} UNION ALL SELECT 'title', 0, ''""")
query("b13_check_types", lambda t: Q.check_types(t.graded, {"price": "currency", "email": "email"}, "seq").drop("samples"), f"""
  SELECT 'price' AS field, 'currency' AS kind, count(*) FILTER ({_BADP}) AS violations, min(seq) FILTER ({_BADP}) AS first_key, max(seq) FILTER ({_BADP}) AS last_key FROM {{graded}}
  UNION ALL SELECT 'email', 'email', count(*) FILTER ({_BADE}), min(seq) FILTER ({_BADE}), max(seq) FILTER ({_BADE}) FROM {{graded}}""")

fixture("history", "SELECT event_id AS seq, CAST(CAST(round(value * 100) AS BIGINT) AS STRING) AS amount, event_type AS cat, concat('c', CAST(user_id AS STRING)) AS city, 'x@y.example' AS email FROM {events} WHERE ts < TIMESTAMP '2024-01-20'")
fixture("current", "SELECT event_id AS seq, CAST(CAST(round(value * 100) AS BIGINT) + 100000 AS STRING) AS amount, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'click' END AS cat, 'same' AS city, '' AS email FROM {events} WHERE ts >= TIMESTAMP '2024-01-20'")
_FIELDS = ["cat", "city", "email"]
_SHIFT = """SELECT 'distribution_shift' AS kind, field, 'warning' AS severity, sum(abs(coalesce(c, 0) / cn - coalesce(h, 0) / hn)) AS measure FROM (
    SELECT field, value, sum(side) AS c, sum(1 - side) AS h, sum(sum(side)) OVER (PARTITION BY field) AS cn, sum(sum(1 - side)) OVER (PARTITION BY field) AS hn FROM (
      SELECT 'cat' AS field, cat AS value, 1 AS side FROM {current} UNION ALL SELECT 'city', city, 1 FROM {current} UNION ALL SELECT 'cat', cat, 0 FROM {history} UNION ALL SELECT 'city', city, 0 FROM {history}) GROUP BY field, value)
  GROUP BY field HAVING sum(abs(coalesce(c, 0) / cn - coalesce(h, 0) / hn)) >= 0.4"""
_Z = """SELECT 'zscore' AS kind, 'amount' AS field, CASE WHEN abs(z) >= 5 THEN 'critical' ELSE 'warning' END AS severity, z AS measure FROM (
    SELECT ((SELECT avg(CAST(amount AS DOUBLE)) FROM {current}) - avg(CAST(amount AS DOUBLE))) / stddev_pop(CAST(amount AS DOUBLE)) AS z FROM {history}) WHERE abs(z) >= 3"""
_ZERO = "SELECT 'sudden_zero' AS kind, 'email' AS field, 'critical' AS severity, 1.0 AS measure WHERE (SELECT count(*) FROM {current} WHERE email <> '') = 0 AND (SELECT count(*) FROM {history}) > 0"
_SAME = "SELECT 'sudden_identical' AS kind, 'city' AS field, 'critical' AS severity, CAST((SELECT count(DISTINCT city) FROM {history}) AS DOUBLE) AS measure WHERE (SELECT count(DISTINCT city) FROM {current}) = 1"


def _round(df):
    return df.withColumn("measure", F.round("measure", 6))


query("d11_anomaly_zscore", lambda t: _round(Q.zscore(t.current, t.history, ["amount"])), f"SELECT * REPLACE (round(measure, 6) AS measure) FROM ({_Z})")
query("d12_anomaly_sudden_zero", lambda t: _round(Q.sudden_zero(t.current, t.history, _FIELDS)), _ZERO)
query("d13_anomaly_identical", lambda t: _round(Q.sudden_identical(t.current, t.history, _FIELDS)), _SAME)
query("d14_anomaly_distribution", lambda t: _round(Q.distribution_shift(t.current, t.history, _FIELDS)), f"SELECT * REPLACE (round(measure, 6) AS measure) FROM ({_SHIFT})")
query("d15_publication_gate", lambda t: Q.publication_gate(Q.quality_verdict(_report(t)), Q.anomalies(t.current, t.history, ["amount"], _FIELDS)).withColumn("score", F.round("score", 6)), f"""
  WITH {_REPORT}, found AS ({_Z} UNION ALL {_ZERO} UNION ALL {_SAME} UNION ALL SELECT * FROM ({_SHIFT})), seen AS (SELECT count(*) AS anomalies, count(*) FILTER (severity = 'critical') AS critical FROM found)
  SELECT CASE WHEN NOT passed THEN 'QUALITY_FAILED' WHEN critical > 0 THEN 'QUARANTINED' ELSE 'READY' END AS state,
         CASE WHEN NOT passed THEN replace(failed_rules, ',', ', ') WHEN critical > 0 THEN critical || ' critical anomalies' ELSE 'passed' END AS reason, round(score, 6) AS score, anomalies FROM verdict, seen""")
fixture("verdicts", "SELECT n_nationkey AS dataset, n_nationkey % 4 <> 0 AS passed, (n_nationkey % 5) / 4e0 AS score, CASE WHEN n_nationkey % 4 = 0 THEN array('required_fields', 'freshness') ELSE array() END AS failed_rules FROM {nation}".replace("array('required_fields', 'freshness')", "split('required_fields,freshness', ',')").replace("array()", "split('', ',')"))
fixture("dataset_findings", "SELECT c_custkey % 20 AS dataset, CASE c_custkey % 3 WHEN 0 THEN 'critical' ELSE 'warning' END AS severity FROM {customer} WHERE c_custkey % 20 <> 7 AND NOT (c_custkey % 20 = 5 AND c_custkey % 3 = 0)")
_GATE = """
  SELECT dataset, CASE WHEN NOT passed THEN 'QUALITY_FAILED' WHEN {held} THEN 'QUARANTINED' ELSE 'READY' END AS state, CASE WHEN NOT passed THEN 'required_fields, freshness' WHEN {held} THEN critical || ' critical anomalies' ELSE 'passed' END AS reason, score, coalesce(anomalies, 0) AS anomalies
  FROM {{verdicts}} LEFT JOIN (SELECT dataset, count(*) AS anomalies, count(*) FILTER (severity = 'critical') AS critical FROM {{dataset_findings}} GROUP BY dataset) USING (dataset)"""
query("d15_gate_by_dataset", lambda t: Q.publication_gate(t.verdicts, t.dataset_findings, "dataset"), _GATE.format(held="coalesce(critical, 0) > 0"))
query("d15_gate_tolerant", lambda t: Q.publication_gate(t.verdicts, t.dataset_findings, "dataset", block_on_critical=False), _GATE.format(held="false"))
query("d17_duplicate_burst", lambda t: Q.duplicate_burst(t.events, F.col("user_id"), least=80).withColumn("share", F.round("share", 6)), "SELECT user_id AS key, count(*) AS n, round(count(*) / (SELECT count(*) FROM {events}), 6) AS share FROM {events} GROUP BY user_id HAVING count(*) >= 80")
query("d18_identical_fields", lambda t: Q.identical_fields(t.current.withColumn("batch_id", F.col("seq") % 50), "batch_id", ["cat", "city", "email"]), """
  SELECT batch, field, min(value) AS value FROM (SELECT seq % 50 AS batch, 'cat' AS field, cat AS value FROM {current} UNION ALL SELECT seq % 50, 'city', city FROM {current} UNION ALL SELECT seq % 50, 'email', nullif(email, '') FROM {current})
  GROUP BY batch, field HAVING count(value) >= 5 AND count(DISTINCT value) = 1""")
