"""Queries on search planning and leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import quantity as Q
from assayer.functions import urls as U
from assayer.operators import leads as L
from assayer.operators import versions as V
from assayer.plans.base import fixture, query

fixture("products", """
  SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN concat('Panadol 500mg ', CAST(p_size AS STRING), ' Tablets') WHEN 1 THEN concat('Syrup ', CAST(p_size AS STRING), ' ml') WHEN 2 THEN concat('Box of ', CAST(p_size AS STRING)) WHEN 3 THEN concat(CAST(p_size AS STRING), 'kg rice')
    WHEN 4 THEN concat('Drug 10mg x ', CAST(p_size AS STRING)) WHEN 5 THEN '1,200 pcs' WHEN 6 THEN '1.5 L cola' WHEN 7 THEN concat(CAST(p_size AS STRING), ' oz bar') ELSE p_name END AS title,
    CASE WHEN p_partkey % 10 = 0 THEN '20 caps' ELSE '' END AS quantity, p_retailprice AS price FROM {part}""")


def _qty(c: str) -> str:
    num = lambda p: f"TRY_CAST(replace(regexp_extract({c}, '{p}', 1), ',', '') AS DOUBLE)"
    unit = lambda p: f"regexp_replace(lower(regexp_extract({c}, '{p}', 2)), 's$', '')"
    case = lambda m, p: f"CASE {unit(p)} {' '.join(f"WHEN '{k}' THEN {v!r}" for k, v in m.items())} END"
    strength = f"CASE WHEN regexp_matches({c}, '{Q.STRENGTH}') THEN regexp_extract({c}, '{Q.STRENGTH}', 1) || lower(regexp_extract({c}, '{Q.STRENGTH}', 2)) END"
    return (f"CASE WHEN {num(Q.COUNT)} > 0 THEN {{{{'n': {num(Q.COUNT)}, 'u': {case(Q.COUNT_UNITS, Q.COUNT)}, 's': {strength}}}}} WHEN {num(Q.PACK_OF)} > 0 THEN {{{{'n': {num(Q.PACK_OF)}, 'u': 'unit', 's': {strength}}}}} WHEN {num(Q.VOLUME)} > 0 THEN {{{{'n': {num(Q.VOLUME)} * {case(Q.VOLUMES, Q.VOLUME)}, 'u': 'ml', 's': {strength}}}}} "
            f"WHEN {num(Q.WEIGHT)} > 0 THEN {{{{'n': {num(Q.WEIGHT)} * {case(Q.WEIGHTS, Q.WEIGHT)}, 'u': 'g', 's': {strength}}}}} WHEN {strength} IS NOT NULL AND {num(Q.TIMES)} > 0 THEN {{{{'n': {num(Q.TIMES)}, 'u': 'unit', 's': {strength}}}}} END").replace("{{", "{").replace("}}", "}")


query("h8_unit_prices", lambda t: L.unit_prices(t.products, F.col("price")).select("id", "package_quantity", "package_unit", "dose_strength", F.round("single_unit_price", 9).alias("single_unit_price")),
      f"SELECT id, q.n AS package_quantity, q.u AS package_unit, q.s AS dose_strength, round(price / q.n, 9) AS single_unit_price FROM (SELECT id, price, coalesce({_qty('quantity')}, {_qty('title')}) AS q FROM {{products}})")

fixture("leads_raw", """
  SELECT concat(' ', c_name, ' ') AS title, concat('Street ', CAST(c_custkey % 40 AS STRING)) AS address, CAST(c_custkey AS STRING) AS phone,
    CASE c_custkey % 8 WHEN 0 THEN concat('https://www.shop', CAST(c_custkey AS STRING), '.com/x') WHEN 1 THEN 'https://m.facebook.com/page' WHEN 2 THEN 'instagram.com/a' WHEN 3 THEN 'http://10.0.0.1/' WHEN 4 THEN 'not a site' WHEN 5 THEN 'HTTPS://Own.Example.org:8080' WHEN 6 THEN CAST(NULL AS STRING) ELSE '' END AS website,
    CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat('pl', CAST(c_custkey % 900 AS STRING)) END AS place_id, concat('c', CAST(c_custkey % 4 AS STRING)) AS client_id, c_custkey AS seq FROM {customer}""")
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(CASE WHEN contains(w, '://') THEN w ELSE 'http://' || w END, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), ':[0-9]*$', ''), '^www\.', '')"
_KIND = "CASE WHEN NOT regexp_matches(h, '^([a-z0-9]([a-z0-9\\-]{0,61}[a-z0-9])?\\.)+[a-z]{2,}$') THEN 'none' WHEN " + " OR ".join(f"h = '{s}' OR ends_with(h, '.{s}')" for s in U.SOCIAL) + " THEN 'social' ELSE 'own' END"
_SITES = f"sites AS (SELECT *, CASE WHEN w = '' THEN 'none' ELSE {_KIND} END AS kind FROM (SELECT *, {_HOST} AS h FROM (SELECT *, trim(coalesce(website, '')) AS w FROM {{leads_raw}})))"
query("h9_classify_websites", lambda t: t.leads_raw.select("seq", U.website_kind(F.col("website")).alias("kind")), f"WITH {_SITES} SELECT seq, kind FROM sites")
query("a5_lead_columns", lambda t: L.lead_columns(t.leads_raw).select("seq", "website", "has_website", "place_id"), f"WITH {_SITES} SELECT CAST(seq AS VARCHAR) AS seq, coalesce(website, '') AS website, kind = 'own' AS has_website, coalesce(place_id, '') AS place_id FROM sites")
query("b3_filter_no_website", lambda t: L.filter_no_website(L.lead_columns(t.leads_raw)).select("seq", "website_type"), f"WITH {_SITES} SELECT CAST(seq AS VARCHAR) AS seq, kind AS website_type FROM sites WHERE kind <> 'own'")
fixture("lead_memory", "SELECT DISTINCT concat('c', CAST(c_custkey % 3 AS STRING)) AS client_id, concat('pl', CAST(c_custkey % 450 AS STRING)) AS place_id FROM {customer}")
query("c3_annotate_leads", lambda t: L.annotate_leads(t.leads_raw, t.lead_memory).select("seq", "client_id", "lead_status"),
      "SELECT l.seq, l.client_id, CASE WHEN l.place_id IS NULL THEN 'NEW_UNVERIFIED' WHEN m.place_id IS NOT NULL THEN 'EXISTING' ELSE 'NEW' END AS lead_status FROM {leads_raw} l LEFT JOIN {lead_memory} m ON l.client_id = m.client_id AND l.place_id = m.place_id")
query("e4_dedupe_leads", lambda t: V.dedupe_first(t.leads_raw.drop("website"), L.lead_key(t.leads_raw.drop("website")), "seq").select("seq", "place_id"),
      "SELECT min(seq) AS seq, any_value(place_id) AS place_id FROM {leads_raw} GROUP BY coalesce(place_id, lower(trim(title) || '|' || trim(address)))")

fixture("searches", "SELECT CAST(n_nationkey AS BIGINT) AS query_id, concat('cafes ', n_name) AS query, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'Lahore' END AS city FROM {nation}")
fixture("areas", "SELECT c_custkey % 20 AS query_id, c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE concat(' Area ', CAST(c_custkey % 60 AS STRING), CASE WHEN c_custkey % 7 = 0 THEN ' lahore' ELSE '' END) END AS area FROM {customer}")
query("a4_expand_grid", lambda t: L.expand_grid(t.searches, t.areas, 5), """
  WITH d AS (SELECT query_id, arg_min(trim(area), seq) AS area, min(seq) AS seq FROM {areas} WHERE trim(area) <> '' GROUP BY query_id, lower(trim(area))), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS k FROM d)
  SELECT s.query_id, CASE WHEN n.area IS NULL THEN s.query ELSE s.query || ' in ' || n.area || CASE WHEN s.city <> '' AND NOT contains(lower(n.area), 'lahore') THEN ', ' || s.city ELSE '' END END AS query, n.area FROM {searches} s LEFT JOIN n ON n.query_id = s.query_id AND k <= 5""")
fixture("price_items", "SELECT p_partkey AS seq, CASE p_partkey % 5 WHEN 0 THEN 'Free' WHEN 1 THEN concat('$', CAST(p_size AS STRING), '.5') ELSE concat('Rs ', CAST(p_size AS STRING)) END AS price FROM {part}")
query("f1_best_prices", lambda t: L.best_prices(t.price_items, 50), r"SELECT seq, price, TRY_CAST(regexp_extract(price, '-?[0-9][0-9,]*(?:\.[0-9]+)?') AS DOUBLE) AS amount FROM {price_items} WHERE price <> 'Free' ORDER BY amount, seq LIMIT 50")
fixture("found_urls", "SELECT c_custkey % 25 AS query_id, c_custkey AS seq, concat('https://s', CAST(c_custkey AS STRING), '.com', CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN '/product/12345' WHEN 2 THEN '/blog/a/b/c' WHEN 3 THEN '/x/item.html' WHEN 4 THEN '/category/shoes?page=2' WHEN 5 THEN '/a/b/c/d/e/f/777' WHEN 6 THEN '/about' ELSE '/shop/thing.php?id=9' END) AS url FROM {customer}")
_SCORES = {False: (-10, 9 + 1, -6 + 3, 4 + 1 + 4, 1 - 6 - 2, 4 + 5, -6, 1 + 4 + 4 - 2), True: (2, 3 + 1, 3, 1 + 4, 1 + 6 + 3, 4 + 3, 0, 1 + 6 + 4 + 3)}
_URL_CASE = "CASE seq % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_SCORES[False])) + " END"
query("f2_rank_urls", lambda t: L.rank_urls(t.found_urls, 5).select("query_id", "seq", "score", F.col("place").cast("long").alias("place")), f"SELECT query_id, seq, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS place FROM (SELECT *, {_URL_CASE} AS score FROM {{found_urls}})) WHERE place <= 5")
fixture("pinned", "SELECT CAST(n_nationkey AS BIGINT) AS seq, concat('u', CAST(n_nationkey % 10 AS STRING)) AS url FROM {nation}")
fixture("fresh", "SELECT c_custkey AS seq, concat('u', CAST(c_custkey % 100 AS STRING)) AS url FROM {customer}")
query("g1_merge_sources", lambda t: L.merge_sources(t.pinned, t.fresh, 30).select("url", F.col("place").cast("long").alias("place")), """
  SELECT url, place FROM (SELECT url, row_number() OVER (ORDER BY kind, seq, url) AS place FROM (SELECT url, min(kind) AS kind, arg_min(seq, kind * 1000000 + seq) AS seq FROM (SELECT seq, url, 0 AS kind FROM {pinned} UNION ALL SELECT seq, url, 1 FROM {fresh}) GROUP BY url)) WHERE place <= 30""")
query("g5_union_areas", lambda t: L.union_areas({"north": t.pinned.withColumn("x", F.lit(1)), "south": t.fresh}).select("area", "seq", "url", "x"), "SELECT 'north' AS area, seq, url, 1 AS x FROM {pinned} UNION ALL SELECT 'south', seq, url, NULL FROM {fresh}")
