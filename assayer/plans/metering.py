"""Queries on usage, cost, budgets and entitlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import metering as M
from assayer.plans.base import fixture, query

_RES = "CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'token' WHEN 'purchase' THEN 'provider_credit' WHEN 'signup' THEN 'browser_second' ELSE 'vision_call' END"
_ONE = f"""SELECT CAST(event_id AS STRING) AS event_id, concat('c', CAST(user_id % 5 AS STRING)) AS client_id, concat('j', CAST(user_id AS STRING)) AS job_id, {_RES} AS resource_type, CAST(round(value * 100) AS BIGINT) AS quantity,
  CASE WHEN event_id % 2 = 0 THEN '' ELSE 'given' END AS unit, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 END AS BIGINT) AS unit_cost_snapshot, CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 11 - 1 END AS BIGINT) AS total_cost_usd,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('p', CAST(event_id % 3 AS STRING)) END AS provider,
  CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN concat('{{{{"input_tokens": ', CAST(event_id % 900 AS STRING), ', "output_tokens": ', CAST(event_id % 70 AS STRING), '}}}}') WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN '{{{{"breakdown": {{{{"alpha": 2, "beta": 3}}}}}}}}' ELSE '{{{{}}}}' END AS metadata,
  ts AS occurred_at FROM {{events}}"""
fixture("usage_raw", _ONE)
fixture("usage_events", "SELECT * FROM {usage_raw} UNION ALL SELECT * FROM {usage_raw} WHERE CAST(event_id AS BIGINT) % 10 = 0")
fixture("usage_known", "SELECT DISTINCT event_id, client_id, job_id, resource_type, quantity, unit, coalesce(total_cost_usd, 0) AS total_cost_usd, provider, metadata, occurred_at FROM {usage_events}")

query("h15_usage_event_defaults", lambda t: M.usage_event_defaults(t.usage_raw).select("event_id", "unit", "total_cost_usd", "rejected"), f"""
  SELECT event_id, CASE WHEN unit <> '' THEN unit ELSE CASE resource_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in M.UNITS.items())} ELSE 'unit' END END AS unit,
         coalesce(total_cost_usd, quantity * coalesce(unit_cost_snapshot, 0)) AS total_cost_usd, coalesce(quantity < 0 OR unit_cost_snapshot < 0 OR total_cost_usd < 0, false) AS rejected FROM {{usage_raw}}""")
query("i1_dedupe_usage", lambda t: M.dedupe_events(t.usage_events).select("event_id", "client_id", "quantity"), "SELECT DISTINCT event_id, client_id, quantity FROM {usage_events}")
_IN = "occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-25'"
query("d19_usage_summary", lambda t: M.usage_summary(t.usage_known, F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz")), f"""
  SELECT client_id, resource_type, count(*) AS events, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(total_cost_usd) AS BIGINT) AS cost_usd FROM {{usage_known}} WHERE {_IN} GROUP BY ALL
  UNION ALL SELECT client_id, '__total__', count(*) FILTER ({_IN}), CAST(coalesce(sum(quantity) FILTER ({_IN}), 0) AS BIGINT), CAST(coalesce(sum(total_cost_usd) FILTER ({_IN}), 0) AS BIGINT) FROM {{usage_known}} GROUP BY client_id""")
_META = "coalesce(CAST(json_extract_string(metadata, '$.{k}') AS DOUBLE), 0)"
_I, _O = _META.format(k="input_tokens"), _META.format(k="output_tokens")
query("d20_cost_report", lambda t: M.cost_report(t.usage_known).withColumns({"usd": F.round("usd", 6)}), f"""
  SELECT client_id, resource_type, count(*) AS events, CAST(sum(quantity) AS DOUBLE) AS quantity, round(sum(CASE resource_type WHEN 'token' THEN CASE WHEN {_I} <> 0 OR {_O} <> 0 THEN {_I} / 1000 * 7.5e-5 + {_O} / 1000 * 3e-4 ELSE quantity / 1000 * 1.5e-4 END
    WHEN 'provider_credit' THEN quantity * 1e-3 ELSE 0 END), 6) AS usd FROM {{usage_known}} GROUP BY ALL""")
query("d20_provider_costs", lambda t: M.provider_costs(t.usage_known).withColumn("usd", F.round("usd", 6)), """
  SELECT provider, sum(credits) AS credits, round(sum(credits) * 1e-3, 6) AS usd FROM (
    SELECT CASE WHEN provider = '' THEN 'unknown' ELSE provider END AS provider, CAST(quantity AS DOUBLE) AS credits FROM {usage_known} WHERE resource_type = 'provider_credit' AND metadata = '{}'
    UNION ALL SELECT 'alpha', 2 FROM {usage_known} WHERE resource_type = 'provider_credit' AND metadata <> '{}' UNION ALL SELECT 'beta', 3 FROM {usage_known} WHERE resource_type = 'provider_credit' AND metadata <> '{}') GROUP BY provider""")
fixture("model_calls", "SELECT event_type AS kind, CASE user_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gemini-1.5-flash' WHEN 2 THEN 'gpt-4o-mini' ELSE 'homemade' END AS model, event_id % 4000 AS input_tokens, event_id % 900 AS output_tokens FROM {events}")
_PI = " ".join(f"WHEN '{m}' THEN {p[0]!r}" for m, p in M.PRICES.items())
_PO = " ".join(f"WHEN '{m}' THEN {p[1]!r}" for m, p in M.PRICES.items())
query("d21_model_cost", lambda t: M.model_cost(t.model_calls).withColumn("usd", F.round("usd", 4)), f"SELECT kind, count(*) AS calls, round(sum(input_tokens / 1000 * CASE model {_PI} ELSE 0 END + output_tokens / 1000 * CASE model {_PO} ELSE 0 END), 4) AS usd FROM {{model_calls}} GROUP BY kind")
fixture("run_plans", "SELECT o_orderkey AS id, o_custkey % 200 AS pages, 1000 AS tokens_per_page, CASE o_orderkey % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gemini-1.5-pro' ELSE 'none' END AS model, 2 AS seconds_per_page, o_orderkey % 2 AS credits_per_page FROM {orders}")
query("d22_estimate_runs", lambda t: M.estimate_runs(t.run_plans).select("id", F.round("est_usd", 6).alias("est_usd")),
      f"SELECT id, round(pages * tokens_per_page * 0.7e0 / 1000 * CASE model {_PI} ELSE 0 END + pages * tokens_per_page * 0.3e0 / 1000 * CASE model {_PO} ELSE 0 END + pages * credits_per_page * 0.001e0, 6) AS est_usd FROM {{run_plans}}")
query("f3_recent_events", lambda t: M.recent_events(t.usage_known, 20).select("client_id", "event_id", "occurred_at"),
      "SELECT client_id, event_id, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY occurred_at DESC, event_id DESC) AS n FROM {usage_known}) WHERE n <= 20")
fixture("run_metrics", "SELECT event_id AS run_id, concat('c', CAST(user_id % 5 AS STRING)) AS client_id, ts AS occurred_at, user_id % 3 AS pages, event_id % 500 AS tokens, event_id % 2 AS browser_seconds, user_id % 4 AS credits, 0 AS vision_calls, event_id % 7 AS bytes FROM {events}")
query("b14_run_usage_events", lambda t: M.run_usage_events(t.run_metrics).select("run_id", "client_id", "resource_type", "quantity", "unit", F.col("metadata")["run"].alias("run")), """
  SELECT run_id, client_id, resource_type, CAST(quantity AS DOUBLE) AS quantity, unit, CAST(run_id AS VARCHAR) AS run FROM (""" + " UNION ALL ".join(
      f"SELECT run_id, client_id, '{r}' AS resource_type, {c} AS quantity, '{M.UNITS[r]}' AS unit FROM {{run_metrics}}" for c, r in {"pages": "page", "tokens": "token", "browser_seconds": "browser_second", "credits": "provider_credit", "vision_calls": "vision_call", "bytes": "storage_byte"}.items()) + ") WHERE quantity > 0")
fixture("job_usage", "SELECT user_id AS job_id, ts AS at_, event_id AS seq, event_id % 3000 AS tokens, (event_id % 8) / 64e0 AS usd, 0 AS credits, event_id % 90 AS pages, event_id % 120 AS seconds FROM {events}")
_RUN = ", ".join(f"sum({c}) OVER w AS {c}" for c in ("tokens", "usd", "credits", "pages", "seconds"))
query("e1_budget_trip", lambda t: M.budget_trip(t.job_usage.withColumnRenamed("at_", "at")), f"""
  WITH run AS (SELECT job_id, at_, seq, {_RUN} FROM {{job_usage}} WINDOW w AS (PARTITION BY job_id ORDER BY at_, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  marked AS (SELECT *, CASE WHEN tokens >= 100000 THEN 'max_tokens' WHEN usd >= 0.5 THEN 'max_usd' WHEN pages >= 5000 THEN 'max_pages' WHEN seconds >= 3600 THEN 'max_seconds' END AS why FROM run)
  SELECT job_id, arg_min(seq, (at_, seq)) FILTER (why IS NOT NULL) AS trip_seq, arg_min(why, (at_, seq)) FILTER (why IS NOT NULL) AS reason,
         bool_or(why IS NULL AND (round(tokens / 100000, 4) >= 0.8 OR round(usd / 0.5, 4) >= 0.8 OR round(pages / 5000, 4) >= 0.8)) AS warned FROM marked GROUP BY job_id""")
fixture("credit_limits", "SELECT DISTINCT concat('p', CAST(user_id % 4 AS STRING)) AS provider, (user_id % 4) * 20000 AS monthly_limit, 500 AS emergency_reserve FROM {events}")
fixture("credit_usage", "SELECT concat('p', CAST(user_id % 4 AS STRING)) AS provider, ts AS at_, event_id % 9 AS credits FROM {events}")
query("e3_credit_headroom", lambda t: M.credit_headroom(t.credit_usage.withColumnRenamed("at_", "at"), t.credit_limits), """
  WITH d AS (SELECT provider, date_trunc('day', at_) AS day, sum(credits) AS used FROM {credit_usage} GROUP BY ALL), m AS (SELECT provider, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(used) AS BIGINT) AS used_month, CAST(max(used) AS BIGINT) AS most_day FROM d GROUP BY ALL)
  SELECT provider, month, used_month, most_day, CASE WHEN monthly_limit > 0 THEN greatest(0, monthly_limit - emergency_reserve - used_month) ELSE 0 END AS remaining, monthly_limit > 0 AND monthly_limit - emergency_reserve - used_month >= 1 AS can_use FROM m JOIN {credit_limits} USING (provider)""")

fixture("requests", "SELECT DISTINCT concat('c', CAST(user_id % 7 AS STRING)) AS client_id, " + _RES + " AS resource, CAST(1000 AS BIGINT) AS amount FROM {events}")
fixture("clients", "SELECT DISTINCT concat('c', CAST(user_id % 5 AS STRING)) AS client_id, CASE user_id % 5 WHEN 0 THEN 'pro' WHEN 1 THEN 'team' ELSE 'free' END AS plan, user_id % 5 AS k FROM {events}")


def _clients(t):
    add, none = F.when(F.col("k") == 1, F.array(F.lit("sso"), F.lit("api"))), F.array().cast("array<string>")
    return t.clients.select("client_id", "plan", F.when(F.col("k") == 2, F.create_map(F.lit("page"), F.lit(900000))).alias("overrides"), F.coalesce(add, none).alias("add_features"), F.when(F.col("k") == 0, F.array(F.lit("export"))).otherwise(none).alias("remove_features"))


def _plans(t):
    rows = t.clients.select("plan").distinct()
    limits = F.when(F.col("plan") == "free", F.create_map(F.lit("page"), F.lit(1000), F.lit("token"), F.lit(1000))).when(F.col("plan") == "team", F.create_map(F.lit("page"), F.lit(10)))
    policy = F.when(F.col("plan") == "team", "WARN").otherwise("BLOCK")
    features = F.when(F.col("plan") == "free", F.array(F.lit("csv"))).otherwise(F.array(F.lit("csv"), F.lit("export")))
    return rows.select("plan", limits.alias("limits"), policy.alias("overage_policy"), features.alias("features"))


query("c6_check_entitlements", lambda t: M.check_entitlements(t.requests, t.usage_known, _plans(t), _clients(t)), """
  WITH used AS (SELECT client_id, resource_type AS resource, CAST(sum(quantity) AS BIGINT) AS used FROM {usage_known} GROUP BY ALL),
  j AS (SELECT r.*, coalesce(c.plan, 'free') AS plan, c.k, coalesce(u.used, 0) AS used, CASE WHEN c.k = 2 AND resource = 'page' THEN 900000 WHEN coalesce(c.plan, 'free') = 'free' AND resource IN ('page', 'token') THEN 1000 WHEN c.plan = 'team' AND resource = 'page' THEN 10 END AS "limit"
    FROM {requests} r LEFT JOIN {clients} c USING (client_id) LEFT JOIN used u USING (client_id, resource))
  SELECT client_id, resource, amount, plan, "limit", used, CASE WHEN "limit" IS NOT NULL THEN greatest(0, "limit" - used) END AS remaining, "limit" IS NULL OR used + amount <= "limit" OR plan = 'team' AS allowed,
         CASE WHEN "limit" IS NULL THEN 'no limit' WHEN used + amount <= "limit" THEN 'within limit' WHEN plan = 'team' THEN 'over limit, warned' ELSE 'over limit' END AS reason FROM j""")
query("c7_client_features", lambda t: M.client_features(_clients(t), _plans(t)).select("client_id", F.array_join("features", ",").alias("features")),
      "SELECT client_id, CASE k WHEN 0 THEN 'csv' WHEN 1 THEN 'api,csv,export,sso' ELSE 'csv' END AS features FROM {clients}")
