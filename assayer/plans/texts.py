"""Queries on text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import texts as T
from assayer.plans.base import fixture, query

_N = {k: f"length(regexp_replace(text, '[^{v}]', '', 'g'))" for k, v in T.SCRIPTS.items()}
_BEST = f"list_max([{', '.join(f"({n}) * 100 + {99 - i}" for i, n in enumerate(_N.values()))}])"
fixture("mixed_script_texts", "SELECT doc_id, concat(text, CASE doc_id % 6 WHEN 0 THEN ' привет мир' WHEN 1 THEN 'Καλημέρα κόσμε abc' WHEN 2 THEN '12 34' WHEN 3 THEN '你好世界 hi' ELSE '' END) AS text FROM {documents}")
for _name in ("h11_script_family", "h11_script_family_whole_texts"):
    query(_name, lambda t: t.mixed_script_texts.withColumn("s", T.script_family(F.col("text"))).select("doc_id", "s.script", F.round("s.share", 6).alias("share")), f"""
  SELECT doc_id, CASE WHEN total = 0 THEN 'unknown' ELSE [{', '.join(f"'{k}'" for k in T.SCRIPTS)}][100 - best % 100] END AS script, CASE WHEN total = 0 THEN 0 ELSE round(floor(best / 100) / total, 6) END AS share
  FROM (SELECT doc_id, {_BEST} AS best, {' + '.join(_N.values())} AS total FROM {{mixed_script_texts}})""")
fixture("contacts", "SELECT doc_id, concat(text, ' Mail a', CAST(doc_id % 5 AS STRING), '@x.org or b@y.com, a', CAST(doc_id % 5 AS STRING), '@x.org; call +1 555-123-', CAST(1000 + doc_id % 9000 AS STRING), ' by 2024-01-05, room 123 4567', CASE WHEN doc_id % 2 = 0 THEN ' or 0300 1234567' ELSE '' END) AS text FROM {documents}")
_PHONE = T.PHONE.replace("'", "''")
_PHONES = f"list_filter(regexp_extract_all(regexp_replace(text, '{T.EMAIL}', ' ', 'g'), '{_PHONE}'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 9 AND NOT regexp_matches(p, '{T.ISO_DATE}'))"
_FIRSTS = lambda kind, x: f"list_transform(list_sort(list_transform(list_distinct({x}), lambda v: struct_pack(at := list_position({x}, v), v := v))), lambda s, i: struct_pack(token := '<{kind}_' || i || '>', value := s.v))"
for _name in ("h12_redact_contacts", "h12_redact_whole_texts"):
    query(_name, lambda t: T.redact_contacts(t.contacts).select("doc_id", "redacted", "has_pii", (T.restore_contacts(F.col("redacted"), F.col("replacements")) == F.col("text")).alias("restored")), f"""
  WITH RECURSIVE found AS (SELECT doc_id, text, {_FIRSTS("EMAIL", "emails")} || {_FIRSTS("PHONE", "phones")} AS values_ FROM (SELECT doc_id, text, regexp_extract_all(text, '{T.EMAIL}') AS emails, {_PHONES} AS phones FROM {{contacts}})),
  steps AS (SELECT doc_id, text, list_sort(list_transform(values_, lambda s: struct_pack(o := -length(s.value), token := s.token, value := s.value))) AS todo, 1 AS k FROM found
    UNION ALL SELECT doc_id, replace(text, todo[k].value, todo[k].token), todo, k + 1 FROM steps WHERE k <= len(todo))
  SELECT doc_id, text AS redacted, len(todo) > 0 AS has_pii, true AS restored FROM steps WHERE k = len(todo) + 1""")
fixture("prompts", """
  SELECT conv_id, turn, concat(CASE turn % 9 WHEN 0 THEN 'Get all products as CSV ' WHEN 1 THEN 'just this page, in excel ' WHEN 2 THEN 'up to 12 pages with full description ' WHEN 3 THEN 'bypass the paywall ' WHEN 4 THEN 'solve   the captcha and give JSON ' WHEN 5 THEN 'log in with my password ' WHEN 6 THEN 'max 900 pages ' WHEN 7 THEN 'browse, 0 pages ' ELSE '' END, text) AS text,
         CASE WHEN conv_id % 5 = 0 THEN 'auto' ELSE '' END AS pagination, CASE WHEN conv_id % 7 = 0 THEN 'none' END AS detail_pages, CASE conv_id % 4 WHEN 0 THEN '7' WHEN 1 THEN 'many' ELSE '' END AS max_pages FROM {conversations}""")


def _tag(name: str, pattern: str) -> str:
    return f"WHEN regexp_matches(text, '{pattern.replace(chr(39), chr(39) * 2)}') THEN '{name.replace(chr(39), chr(39) * 2)}'"


_PAGED = f"CASE WHEN pagination <> '' THEN pagination WHEN NOT regexp_matches(text, '{T.HINTS["single_page"]}') AND regexp_matches(text, '{T.HINTS["multipage"]}') THEN 'auto' ELSE 'none' END"
query("h13_prompt_tags", lambda t: t.prompts.select("conv_id", "turn", *(c.alias(n) for n, c in T.prompt_tags(F.col("text"), F.struct("pagination", "detail_pages", "max_pages")).items())), f"""
  SELECT conv_id, turn, {_PAGED} AS pagination, coalesce(detail_pages, CASE WHEN regexp_matches(text, '{T.HINTS["detail_pages"]}') THEN 'required' WHEN {_PAGED} = 'auto' THEN 'optional' ELSE 'none' END) AS detail_pages,
         CASE WHEN number IS NULL THEN 5 WHEN number < 1 THEN 1 WHEN number > 500 THEN 500 ELSE number END AS max_pages,
         CASE {' '.join(_tag(k, v) for k, v in T.FORMATS.items())} ELSE 'xlsx' END AS output_format, CASE {' '.join(_tag(k, v) for k, v in T.FORBIDDEN.items())} END AS forbidden
  FROM (SELECT *, coalesce(TRY_CAST(max_pages AS INTEGER), TRY_CAST(regexp_extract(text, '{T.PAGE_NUMBER}', 1) AS INTEGER)) AS number FROM {{prompts}})""")
query("h14_prompt_keys", lambda t: T.prompt_keys(t.prompts).groupBy("n").agg(F.count("*").alias("keys"), F.sum("bytes_saved").alias("bytes_saved")), r"""
  SELECT n, count(*) AS keys, CAST(sum(s) AS BIGINT) AS bytes_saved FROM (SELECT count(*) AS n, sum(strlen(text)) - max(strlen(text)) AS s FROM {prompts} GROUP BY trim(regexp_replace(text, '\s+', ' ', 'g'))) GROUP BY n""")
fixture("cache_rows", "SELECT event_id AS key, user_id % 6 AS tenant, ts AS created_at, ts + INTERVAL '1' HOUR AS used_at, CAST(round(value) AS BIGINT) AS bytes FROM {events}")
query("e7_cache_retention", lambda t: T.cache_retention(t.cache_rows, F.lit("2024-01-31").cast("timestamp_ntz"), 12 * 86400, 500, 20000).select("tenant", "key", "bytes"), """
  SELECT tenant, key, bytes FROM (SELECT *, row_number() OVER w AS n, sum(bytes) OVER (PARTITION BY tenant ORDER BY used_at DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM {cache_rows}
    WHERE epoch(TIMESTAMP '2024-01-31') - floor(epoch(created_at)) <= 1036800 WINDOW w AS (PARTITION BY tenant ORDER BY used_at DESC, key)) WHERE n <= 500 AND b <= 20000""")
fixture("cache_lookups", "SELECT user_id % 7 AS tenant, event_id % 4 <> 0 AS hit FROM {events}")
query("e7_cache_stats", lambda t: T.cache_stats(t.cache_rows, t.cache_lookups, F.lit("2024-01-31").cast("timestamp_ntz"), 12 * 86400, 500, 20000), """
  WITH a AS (SELECT *, epoch(TIMESTAMP '2024-01-31') - floor(epoch(created_at)) <= 1036800 AS alive FROM {cache_rows}),
  p AS (SELECT *, row_number() OVER w AS n, sum(bytes) OVER (PARTITION BY tenant, alive ORDER BY used_at DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM a WINDOW w AS (PARTITION BY tenant, alive ORDER BY used_at DESC, key)),
  c AS (SELECT tenant, count(*) FILTER (alive AND n <= 500 AND b <= 20000) AS entry_count, count(*) FILTER (NOT alive) AS expired, count(*) FILTER (alive AND NOT (n <= 500 AND b <= 20000)) AS evicted, CAST(coalesce(sum(bytes) FILTER (alive AND n <= 500 AND b <= 20000), 0) AS BIGINT) AS total_bytes FROM p GROUP BY tenant),
  l AS (SELECT tenant, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM {cache_lookups} GROUP BY tenant)
  SELECT coalesce(c.tenant, l.tenant) AS tenant, coalesce(entry_count, 0) AS entry_count, coalesce(expired, 0) AS expired, coalesce(evicted, 0) AS evicted, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, coalesce(total_bytes, 0) AS total_bytes, coalesce(round(hits / (hits + misses), 4), 0) AS hit_rate
  FROM c FULL JOIN l ON c.tenant = l.tenant""")
query("h16_json_paths", lambda t: t.events.select("event_id", T.json_path(F.col("props"), "k").alias("k"), T.json_ld(F.concat(F.lit('{"@graph": [{"@type": "Org"}, {"@type": "Product", "offers": [{"price": "'), F.col("user_id").cast("string"), F.lit('"}]}]}')), "Product", "offers.0.price").alias("price")),
      "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS price FROM {events}")
