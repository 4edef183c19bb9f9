"""Queries on versions of a dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import versions as V
from assayer.plans.base import fixture, query

_BASE = "SELECT o_orderkey AS seq, concat('Order ', CAST(o_orderkey % 4000 AS STRING)) AS title, {price} AS price, {note} AS note, o_orderstatus AS availability, {at} AS updated_at FROM {{orders}} WHERE o_orderkey % 10 <> {cut}"
fixture("prev", _BASE.format(price="concat('$', CAST(o_custkey AS STRING))", note="o_orderpriority", at="'2024-01-01'", cut=0))
fixture("cur", _BASE.format(price="CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_custkey AS STRING), '.00 EUR') WHEN o_orderkey % 3 = 1 THEN concat('$', CAST(o_custkey + 1 AS STRING)) ELSE concat('$', CAST(o_custkey AS STRING)) END",
                            note="CASE WHEN o_orderkey % 4 = 0 THEN concat(' ', lower(o_orderpriority), '  ') WHEN o_orderkey % 4 = 1 THEN concat(o_orderpriority, '!') ELSE o_orderpriority END", at="'2024-02-01'", cut=1))

_AMOUNT = r"TRY_CAST(replace(regexp_extract({c}, '-?[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE)"
_PLAIN = r"lower(regexp_replace(trim(coalesce({c}, '')), '\s+', ' ', 'g'))"
_CHANGES = f"""
  p AS (SELECT title, arg_max(price, seq) AS price, arg_max(note, seq) AS note, arg_max(availability, seq) AS availability FROM {{prev}} GROUP BY title),
  c AS (SELECT title, arg_max(price, seq) AS price, arg_max(note, seq) AS note, arg_max(availability, seq) AS availability FROM {{cur}} GROUP BY title),
  both_ AS (SELECT coalesce(p.title, c.title) AS identity, p.title IS NULL AS is_new, c.title IS NULL AS is_gone, p.price AS op, c.price AS np, p.note AS on_, c.note AS nn, p.availability AS oa, c.availability AS na FROM p FULL JOIN c ON p.title = c.title),
  flags AS (SELECT *, NOT is_new AND NOT is_gone AND {_AMOUNT.format(c='op')} <> {_AMOUNT.format(c='np')} AS dp, NOT is_new AND NOT is_gone AND {_PLAIN.format(c='on_')} <> {_PLAIN.format(c='nn')} AS dn, NOT is_new AND NOT is_gone AND {_PLAIN.format(c='oa')} <> {_PLAIN.format(c='na')} AS da FROM both_),
  changes AS (SELECT *, CASE WHEN is_new THEN 'NEW' WHEN is_gone THEN 'REMOVED' WHEN dp OR dn OR da THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change_type FROM flags)"""
query("c1_classify_changes", lambda t: V.classify_changes(t.prev, t.cur).select("identity", "change_type", F.array_join(F.col("field_changes.field"), ",").alias("fields")),
      f"WITH {_CHANGES} SELECT identity, change_type, concat_ws(',', CASE WHEN da THEN 'availability' END, CASE WHEN dn THEN 'note' END, CASE WHEN dp THEN 'price' END) AS fields FROM changes")
query("d16_change_summary", lambda t: V.change_summary(V.classify_changes(t.prev, t.cur)).select("new", "removed", "modified", "unchanged", "total", F.array_join("highlights", "; ").alias("highlights")), f"""
  WITH {_CHANGES}, n AS (SELECT count(*) FILTER (dp AND {_AMOUNT.format(c='np')} < {_AMOUNT.format(c='op')}) AS down, count(*) FILTER (dp AND {_AMOUNT.format(c='np')} > {_AMOUNT.format(c='op')}) AS up, count(*) FILTER (da) AS flips, count(*) FILTER (dn) AS notes,
    count(*) FILTER (change_type = 'NEW') AS "new", count(*) FILTER (change_type = 'REMOVED') AS removed, count(*) FILTER (change_type = 'MODIFIED') AS modified, count(*) FILTER (change_type = 'UNCHANGED') AS unchanged, count(*) AS total FROM changes)
  SELECT "new", removed, modified, unchanged, total, concat_ws('; ', CASE WHEN down > 0 THEN down || ' price decrease(s)' END, CASE WHEN up > 0 THEN up || ' price increase(s)' END, CASE WHEN flips > 0 THEN flips || ' availability flip(s)' END, CASE WHEN notes > 0 THEN notes || ' note change(s)' END) AS highlights FROM n""")

_UNSIGNED = r"TRY_CAST(replace(regexp_extract({c}, '[0-9,]+\.?[0-9]*'), ',', '') AS DOUBLE)"
query("c2_diff_prices", lambda t: V.diff_prices(t.cur, t.prev).select("seq", "title", "price", "diff_status"), f"""
  WITH p AS (SELECT title, arg_max(price, seq) AS price, max(seq) AS seq FROM {{prev}} GROUP BY title)
  SELECT c.seq, c.title, c.price, CASE WHEN p.title IS NULL THEN 'New' WHEN {_UNSIGNED.format(c='c.price')} <> {_UNSIGNED.format(c='p.price')} THEN 'Price Changed (was ' || p.price || ')' ELSE 'Unchanged' END AS diff_status
  FROM {{cur}} c LEFT JOIN p ON p.title = c.title UNION ALL SELECT seq, title, price, 'Removed' FROM p WHERE title NOT IN (SELECT title FROM {{cur}})""")

fixture("run_history", "SELECT o_orderkey AS seq, CAST(o_custkey % 50 AS BIGINT) AS client, CAST(o_orderdate AS DATE) AS created, o_orderstatus AS data FROM {orders}")
query("a12_latest_snapshot", lambda t: V.latest_snapshot(t.run_history, ["client"], "created", F.lit("1998-01-01").cast("date")),
      "SELECT seq, client, created, data FROM (SELECT *, max(created) OVER (PARTITION BY client) AS m FROM {run_history} WHERE created < DATE '1998-01-01') WHERE created = m")
fixture("dataset_versions", "SELECT o_orderkey AS seq, concat('task', CAST(o_custkey % 100 AS STRING)) AS task_key, o_orderdate AS created_at, o_orderkey % 4 <> 0 AS quality_passed, o_orderkey % 9 = 0 AS superseded FROM {orders}")
query("e6_version_chain", lambda t: V.version_chain(t.dataset_versions).select("seq", "task_key", "version", "is_latest", "is_latest_valid"), """
  SELECT seq, task_key, version, version = max(version) OVER w AS is_latest, coalesce(version = max(CASE WHEN quality_passed AND NOT superseded THEN version END) OVER w, false) AS is_latest_valid
  FROM (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY created_at, seq) AS version FROM {dataset_versions}) WINDOW w AS (PARTITION BY task_key)""")
fixture("task_versions", "SELECT concat('t', CAST(o_custkey AS STRING)) AS task, CAST(o_orderkey AS BIGINT) AS version, o_orderpriority AS payload FROM {orders} WHERE o_custkey % 3 <> 0")
fixture("task_specs", "SELECT concat('t', CAST(c_custkey AS STRING)) AS task, CASE WHEN c_custkey % 2 = 0 THEN '5-LOW' ELSE '1-URGENT' END AS payload FROM {customer}")
query("a13_version_upsert", lambda t: V.version_upsert(t.task_versions, t.task_specs, "task"), """
  WITH cur_ AS (SELECT task, max(version) AS version, arg_max(payload, version) AS payload FROM {task_versions} GROUP BY task)
  SELECT s.task, coalesce(c.version, 0) + 1 AS version, s.payload FROM {task_specs} s LEFT JOIN cur_ c ON c.task = s.task WHERE c.task IS NULL OR c.payload <> s.payload""")
fixture("stock_table", "SELECT p_partkey % 1500 AS id, min(p_partkey) AS seq, min(p_name) AS name, min(p_size) AS first_size FROM {part} WHERE p_partkey % 2 = 0 GROUP BY 1")
fixture("stock_updates", "SELECT p_partkey % 1500 AS id, p_partkey AS seq, p_brand AS name, p_size AS first_size FROM {part} WHERE p_partkey % 3 = 0")
query("a10_upsert_latest", lambda t: V.upsert_latest(t.stock_table, t.stock_updates, ["id"], "seq", keep=["first_size"]), """
  WITH u AS (SELECT id, arg_max(name, seq) AS name, max(seq) AS seq, arg_min(first_size, seq) AS first_size FROM {stock_updates} GROUP BY id)
  SELECT coalesce(t.id, u.id) AS id, coalesce(u.seq, t.seq) AS seq, coalesce(u.name, t.name) AS name, coalesce(t.first_size, u.first_size) AS first_size FROM {stock_table} t FULL JOIN u ON t.id = u.id""")
query("g4_schema_change", lambda t: V.schema_change(t.prev.withColumn("old_only", F.lit("x")).withColumn("empty", F.lit("")), t.cur.withColumn("empty", F.lit("y"))).select(F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed")),
      "SELECT CASE WHEN (SELECT count(*) FROM {cur}) > 0 THEN 'empty' END AS added, CASE WHEN (SELECT count(*) FROM {prev}) > 0 THEN 'old_only' END AS removed")
query("g2_same_identities", lambda t: V.same_identities(t.prev, t.cur, "title"),
      "SELECT count(*) = 0 AS same FROM ((SELECT title FROM {prev} EXCEPT SELECT title FROM {cur}) UNION ALL (SELECT title FROM {cur} EXCEPT SELECT title FROM {prev}))")
query("e4_dedupe_first", lambda t: V.dedupe_first(t.prev, F.col("title"), "seq").select("seq", "title", "price"), "SELECT min(seq) AS seq, title, arg_min(price, seq) AS price FROM {prev} GROUP BY title")
#: The digest of a set in SQL, over column d.
V_DIGEST = "sha256(concat_ws(':', CAST(count(d) AS VARCHAR), " + ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 15 * k}, 15) AS BIGINT)) AS VARCHAR)" for k in range(4)) + "))"
_ROW = """sha256('{{"note":' || to_json(note) || ',"price":' || to_json(price) || ',"seq":' || seq || ',"title":' || to_json(title) || '}}')""".replace("{{", "{").replace("}}", "}")
query("d35_dataset_digest", lambda t: V.dataset_digest(t.prev.select("seq", "title", "price", "note")), f"SELECT count(*) AS rows, {V_DIGEST} AS digest FROM (SELECT {_ROW} AS d FROM {{prev}})")
