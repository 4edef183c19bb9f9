"""Queries on consensus, confidence and trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import trust as T
from assayer.plans.base import fixture, query

fixture("observations", """
  SELECT l_orderkey * 1000000 + l_suppkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS seq, concat('rec_', CAST(l_partkey AS STRING)) AS record_id, 'price' AS field_name,
         concat('s', CAST(l_suppkey AS STRING), '.example') AS source_domain,
         concat('$', CAST(CAST(l_partkey % 90 + 10 + CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey % 4 ELSE 0 END AS BIGINT) AS STRING), CASE WHEN l_orderkey % 2 = 0 THEN '.50' ELSE '.5' END) AS value,
         (s_suppkey % 10 + 1) / 16e0 AS trust_score, CASE WHEN l_suppkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE n_name END AS independence_group
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""")

_VOTES = r"""votes AS (
  SELECT min(seq) AS seq, record_id, field_name, value, source_domain AS source, coalesce(independence_group, source_domain) AS g,
         printf('%.4f', CAST(regexp_replace(value, '[^0-9.\-+]', '', 'g') AS DOUBLE)) AS norm, trust_score AS w, seq AS s, row_number() OVER () AS _r
  FROM {observations} GROUP BY ALL),
by_value AS (SELECT record_id, field_name, g, norm, sum(w) AS w, min(seq) AS first_seq, arg_min(value, seq) AS raw, count(*) AS n FROM votes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id, field_name, g ORDER BY round(w, 9) DESC, first_seq) AS rn, min(first_seq) OVER (PARTITION BY record_id, field_name, g) AS g_seq FROM by_value),
vals AS (SELECT record_id, field_name, norm, sum(w) AS w, sum(n) AS n, count(*) AS clusters, min(g_seq) AS first_seq, arg_min(raw, g_seq) AS raw FROM ranked WHERE rn = 1 GROUP BY ALL),
fields AS (SELECT record_id, field_name, sum(w) AS total, sum(clusters) AS clusters, count(*) AS n_values FROM vals GROUP BY ALL),
winners AS (
  SELECT v.*, f.total, f.clusters AS total_clusters, f.n_values, row_number() OVER (PARTITION BY v.record_id, v.field_name ORDER BY round(v.w, 9) DESC, v.n, v.first_seq) AS place
  FROM vals v JOIN fields f ON v.record_id = f.record_id AND v.field_name = f.field_name),
consensus AS (
  SELECT record_id, field_name, raw AS consensus_value, norm AS normalized_value, w / total * least(1.0, 0.4 + 0.2 * (total_clusters - 1)) AS confidence, n AS n_sources, total_clusters, n_values - 1 AS n_conflicts
  FROM winners WHERE place = 1)"""
_VOTES = _VOTES.replace("min(seq) AS seq, ", "seq, ").replace(", seq AS s, row_number() OVER () AS _r", "").replace("\n  FROM {observations} GROUP BY ALL)", "\n  FROM {observations})")


def _consensus(t):
    return T.consensus(t.observations)


query("d1_triangulate", lambda t: _consensus(t).select(
    "record_id", "field_name", "consensus_value", "normalized_value", F.round("confidence", 6).alias("confidence"), "n_sources", "total_clusters", "n_conflicts"),
    f"WITH {_VOTES} SELECT record_id, field_name, consensus_value, normalized_value, round(confidence, 6) AS confidence, CAST(n_sources AS BIGINT) AS n_sources, CAST(total_clusters AS BIGINT) AS total_clusters, CAST(n_conflicts AS BIGINT) AS n_conflicts FROM consensus")
query("d1_triangulate_lists", lambda t: T.triangulate(t.observations).select(
    "record_id", "field_name", "consensus_value", F.round("confidence", 6).alias("confidence"), F.array_join("winning_sources", ",").alias("winning_sources"),
    F.array_join(F.transform("conflicts", lambda c: F.concat_ws("=", c["normalized"], F.array_join(c["sources"], "+"))), ",").alias("conflicts")),
    f"""WITH {_VOTES}, lists AS (SELECT v.record_id, v.field_name, v.norm, string_agg(v.source, ',' ORDER BY r.g_seq, v.seq) AS sources FROM votes v JOIN ranked r ON v.record_id = r.record_id AND v.field_name = r.field_name AND v.g = r.g AND v.norm = r.norm AND r.rn = 1 GROUP BY ALL)
  SELECT w.record_id, w.field_name, max(w.raw) FILTER (place = 1) AS consensus_value, round(max(w.w / w.total * least(1.0, 0.4 + 0.2 * (w.total_clusters - 1))) FILTER (place = 1), 6) AS confidence, max(l.sources) FILTER (place = 1) AS winning_sources,
         coalesce(string_agg(w.norm || '=' || replace(l.sources, ',', '+'), ',' ORDER BY w.first_seq) FILTER (place > 1), '') AS conflicts
  FROM winners w JOIN lists l ON l.record_id = w.record_id AND l.field_name = w.field_name AND l.norm = w.norm GROUP BY ALL""")
query("consensus_confidence", lambda t: T.record_confidence(_consensus(t)).select("record_id", F.round("confidence", 6).alias("confidence")),
      f"WITH {_VOTES} SELECT record_id, round(min(confidence), 6) AS confidence FROM consensus GROUP BY record_id")

fixture("base_records", "SELECT p_partkey AS seq, concat('rec_', CAST(p_partkey AS STRING)) AS record_id, p_name AS title, 'none' AS price FROM {part}")
query("b10_consensus_to_records", lambda t: T.consensus_to_records(_consensus(t), t.base_records, ["price"]),
      f"WITH {_VOTES} SELECT b.record_id, coalesce(c.consensus_value, b.price) AS price, b.seq, b.title FROM {{base_records}} b LEFT JOIN consensus c ON b.record_id = c.record_id")

fixture("offers", "SELECT CAST(p_partkey % 200 AS STRING) AS product, concat('src', CAST(p_partkey % 7 AS STRING)) AS source, p_retailprice AS price FROM {part}")
query("d2_price_agreement", lambda t: T.price_agreement(t.offers).select("product", "source", "price", F.round("agreement", 6).alias("agreement"), "n"),
      "SELECT product, source, price, round(greatest(0.0, 1 - abs(price - m) / m), 6) AS agreement, n FROM (SELECT *, avg(price) OVER (PARTITION BY product) AS m, count(*) OVER (PARTITION BY product) AS n FROM {offers})")

fixture("confidence_inputs", """
  SELECT o_orderkey AS id, concat('rec_', CAST(o_custkey AS STRING)) AS record_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 10) / 9e0 END AS consensus, CAST(o_orderkey % 5 AS INT) AS source_count,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 11) / 10e0 END AS mean_trust, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 13) / 12e0 END AS freshness,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 9e-1 END AS selector, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS validation_passed,
         CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE (o_orderkey % 8) / 7e0 END AS historical_stability, CASE WHEN o_orderkey % 9 = 0 THEN 8e-1 ELSE NULL END AS anomaly_score
  FROM {orders}""")
_PARTS = {"consensus": "consensus", "mean_trust": "mean_trust", "freshness": "freshness", "selector": "selector", "historical_stability": "historical_stability", "validation": "CAST(CAST(validation_passed AS INTEGER) AS DOUBLE)",
          "source_count": "CASE WHEN source_count = 1 THEN 0.2 WHEN source_count = 2 THEN 0.6 WHEN source_count > 2 THEN 1.0 END"}
_TOTAL = " + ".join(f"CASE WHEN {e} IS NULL THEN 0 ELSE {T.WEIGHTS[k]} END" for k, e in _PARTS.items())
_SUM = " + ".join(f"coalesce({T.WEIGHTS[k]} * {e}, 0)" for k, e in _PARTS.items())
_SCORED = f"SELECT *, coalesce(least(greatest(({_SUM}) / nullif({_TOTAL}, 0) - coalesce(anomaly_score * 0.05, 0), 0), 1), 0) AS confidence FROM {{confidence_inputs}}"
query("d3_score_confidence", lambda t: T.score_confidence(t.confidence_inputs.withColumn("validation_passed", F.col("validation_passed").cast("boolean"))).select("id", F.round("confidence", 6).alias("confidence"), "reasons"), f"""
  SELECT id, round(confidence, 6) AS confidence, CASE WHEN r = '' THEN 'mixed signals' ELSE r END AS reasons FROM (SELECT *, concat_ws(', ',
    CASE WHEN consensus >= 0.8 THEN 'sources agree' WHEN consensus < 0.5 THEN 'sources disagree' END, CASE WHEN source_count = 1 THEN 'one source only' END,
    CASE WHEN mean_trust >= 0.75 THEN 'trusted sources' WHEN mean_trust < 0.4 THEN 'little trusted sources' END, CASE WHEN freshness >= 0.9 THEN 'fresh' WHEN freshness < 0.4 THEN 'stale' END,
    CASE WHEN NOT validation_passed THEN 'failed validation' END, CASE WHEN historical_stability >= 0.9 THEN 'stable over runs' END, CASE WHEN anomaly_score > 0.5 THEN 'anomaly' END) AS r FROM ({_SCORED}))""")
query("d4_record_confidence", lambda t: T.record_confidence(T.score_confidence(t.confidence_inputs), "mean").select("record_id", F.round("confidence", 6).alias("confidence")),
      f"SELECT record_id, round(avg(confidence), 6) AS confidence FROM ({_SCORED}) GROUP BY record_id")

fixture("trust_events", """
  SELECT event_id AS seq, concat('D', CAST(user_id % 20 AS STRING), '.Example') AS domain, CASE event_type WHEN 'view' THEN 'agree' WHEN 'click' THEN 'agree' WHEN 'purchase' THEN 'disagree' WHEN 'signup' THEN 'stale' ELSE 'violation' END AS kind,
         ts AS seen_at, user_id % 20 = 3 AS manual_authority FROM {events}""")
_TRUST = """SELECT lower(domain) AS domain, count(*) AS observation_count, count(*) FILTER (kind = 'agree') AS agreement_count, count(*) FILTER (kind = 'disagree') AS disagreement_count,
  count(*) FILTER (kind = 'stale') AS staleness_flags, count(*) FILTER (kind = 'violation') AS schema_violations, bool_or(manual_authority) AS manual_authority, max(seen_at) AS last_updated FROM {trust_events} GROUP BY 1"""
_TRUST2 = f"""SELECT *, greatest(0.05, least(0.99, 0.5 + 0.4 * ((agreement_count + 1.0) / (agreement_count + disagreement_count + 2.0) - 0.5) - 0.3 * staleness_flags / observation_count - 0.4 * schema_violations / observation_count
  + CASE WHEN manual_authority THEN 0.2 ELSE 0 END)) AS trust_score FROM ({_TRUST})"""
query("d5_source_trust", lambda t: T.source_trust(t.trust_events).withColumn("trust_score", F.round("trust_score", 6)), f"SELECT * REPLACE (round(trust_score, 6) AS trust_score) FROM ({_TRUST2})")
query("d6_trust_decay", lambda t: T.trust_decay(T.source_trust(t.trust_events.where("not (domain = 'D4.Example' and seen_at > timestamp'2024-01-02')")), F.lit("2024-04-20 00:00:00").cast("timestamp")).select("domain", "observation_count", F.round("trust_score", 6).alias("trust_score")),
      f"""SELECT domain, CASE WHEN epoch(TIMESTAMP '2024-04-20') - floor(epoch(last_updated)) >= 7776000 THEN 0 ELSE observation_count END AS observation_count,
          CASE WHEN epoch(TIMESTAMP '2024-04-20') - floor(epoch(last_updated)) >= 7776000 THEN 0.5 ELSE round(trust_score, 6) END AS trust_score
          FROM ({_TRUST2.replace('FROM {trust_events}', "FROM {trust_events} WHERE NOT (domain = 'D4.Example' AND seen_at > TIMESTAMP '2024-01-02')")})""")
query("d7_trust_updates", lambda t: T.trust_updates(T.triangulate(t.observations)), f"""
  WITH {_VOTES}, sided AS (SELECT DISTINCT v.record_id, v.source, w.place = 1 AS yes FROM votes v JOIN ranked r ON v.record_id = r.record_id AND v.g = r.g AND v.norm = r.norm AND r.rn = 1 JOIN winners w ON w.record_id = v.record_id AND w.norm = v.norm),
  one AS (SELECT record_id, source, bool_or(yes) AS yes FROM sided GROUP BY ALL)
  SELECT source AS domain, sum(CAST(yes AS INTEGER)) AS agreed, sum(1 - CAST(yes AS INTEGER)) AS disagreed FROM one GROUP BY source""")

fixture("old_values", "SELECT concat('rec_', CAST(o_custkey AS STRING)) AS record_id, 'status' AS field_name, o_orderkey AS version, o_orderstatus AS value FROM {orders}")
fixture("new_values", "SELECT concat('rec_', CAST(c_custkey AS STRING)) AS record_id, 'status' AS field_name, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS value FROM {customer}")
query("e8_historical_stability", lambda t: T.historical_stability(t.old_values, t.new_values).withColumn("historical_stability", F.round("historical_stability", 6)),
      "SELECT o.record_id, o.field_name, round(avg(CASE WHEN o.value = n.value THEN 1.0 ELSE 0.0 END), 6) AS historical_stability FROM {old_values} o JOIN {new_values} n ON o.record_id = n.record_id AND o.field_name = n.field_name GROUP BY ALL")

fixture("crawl_runs", "SELECT CAST(o_orderkey % 40 AS BIGINT) AS run_id, concat('https://Site', CAST(o_custkey % 30 AS STRING), '.Example/p/', CAST(o_orderkey AS STRING)) AS url, CASE WHEN o_custkey % 6 = 0 THEN 0 ELSE o_orderkey % 3 END AS records FROM {orders}")
_OUT = """SELECT domain, count(*) AS attempts, count(*) FILTER (records > 0) AS successful_runs, sum(records) AS total_records FROM (
  SELECT run_id, lower(regexp_extract(url, '^https://([^/]+)', 1)) AS domain, sum(records) AS records FROM {crawl_runs} GROUP BY ALL) GROUP BY domain"""
_OUT2 = f"""SELECT *, greatest(0.0, least(1.0, (successful_runs + 1.0) / (attempts + 2.0) + CASE WHEN successful_runs > 0 THEN least(0.15, ln(1 + CAST(total_records AS DOUBLE) / successful_runs) / ln(21.0) * 0.15) ELSE -0.2 END)) AS score FROM ({_OUT})"""
query("d8_domain_outcomes", lambda t: T.domain_outcomes(t.crawl_runs).withColumn("score", F.round("score", 6)), f"SELECT * REPLACE (round(score, 6) AS score) FROM ({_OUT2})")
fixture("scored_urls", "SELECT concat('https://site', CAST(c_custkey % 45 AS STRING), '.example/u/', CAST(c_custkey AS STRING)) AS url, CAST(c_custkey % 10 AS DOUBLE) AS base_score FROM {customer}")
query("c10_apply_reputation", lambda t: T.apply_reputation(t.scored_urls, T.domain_outcomes(t.crawl_runs)).select("url", F.round("adjusted", 6).alias("adjusted")),
      f"SELECT url, round(base_score + (coalesce(score, 0.5) - 0.5) * 8, 6) AS adjusted FROM {{scored_urls}} LEFT JOIN ({_OUT2}) ON domain = regexp_extract(url, '^https://([^/]+)', 1)")
