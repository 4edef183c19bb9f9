"""Queries on readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import cleaning as C
from assayer.operators import quality as Q
from assayer.operators import versions as V
from assayer.plans.base import fixture, query
from assayer.plans.versions import _CHANGES
from assayer.sources import keyed_tables as K
from assayer.sources import readers as R
from assayer.sources import writers as W
from assayer.sources.shared import new_folder

_lines = lambda t: t.pages.select(F.col("page_id").alias("seq"), F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("# "), "url")).when(F.col("page_id") % 7 == 1, "").when(F.col("page_id") % 7 == 2, "ftp://x.example/y").otherwise(F.concat(F.lit(" HTTPS://S"), (F.col("page_id") % 40).cast("string"), F.lit(".Example:443/p#x "))).alias("line"))
query("a1_read_url_list", lambda t: R.clean_url_list(_lines(t)), "SELECT min(page_id) AS seq, 'https://s' || (page_id % 40) || '.example/p' AS url FROM {pages} WHERE page_id % 7 > 2 GROUP BY page_id % 40")
query("a1_dropped_lines", lambda t: R.dropped_lines(_lines(t)), """
  SELECT count(*) AS given, count(DISTINCT CASE WHEN page_id % 7 > 2 THEN page_id % 40 END) AS kept, count(*) FILTER (page_id % 7 = 2) AS not_http, count(*) FILTER (page_id % 7 > 2) - count(DISTINCT CASE WHEN page_id % 7 > 2 THEN page_id % 40 END) AS repeated FROM {pages} WHERE page_id % 7 > 1""")
fixture("sitemaps", """
  SELECT concat('https://h', CAST(c_custkey AS STRING), '.example/sitemap.xml') AS sitemap_url, CASE c_custkey % 4 WHEN 0 THEN concat('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://h', CAST(c_custkey + 1 AS STRING), '.example/sitemap.xml</loc></sitemap></sitemapindex>')
    WHEN 3 THEN '<urlset><url>' ELSE concat('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://h', CAST(c_custkey AS STRING), '.example/a </loc><priority>0.5</priority></url><url><loc></loc></url><url><loc>https://x.example/b</loc><lastmod>2024-01-01</lastmod></url></urlset>') END AS xml FROM {customer}""")
query("a2_sitemap_urls", lambda t: R.sitemap_urls(t.sitemaps).select("root", "url", "lastmod", "priority", "warning"), """
  SELECT 'https://h' || (c_custkey - CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END) || '.example/sitemap.xml' AS root, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN k = 0 THEN 'https://h' || c_custkey || '.example/a' ELSE 'https://x.example/b' END AS url,
         CASE WHEN c_custkey % 4 <> 3 AND k = 1 THEN '2024-01-01' END AS lastmod, CASE WHEN c_custkey % 4 <> 3 AND k = 0 THEN 0.5 END AS priority, CASE WHEN c_custkey % 4 = 3 THEN 'malformed sitemap' END AS warning
  FROM {customer}, (VALUES (0), (1)) AS e(k) WHERE c_custkey % 4 IN (1, 2) OR (c_custkey % 4 = 3 AND k = 0)""")
fixture("tangled_sitemaps", """
  SELECT concat('https://h', CAST(c_custkey AS STRING), '.example/s.xml') AS sitemap_url, CASE c_custkey % 5 WHEN 0 THEN concat('<?xml version="1.0"?><!-- <url><loc>https://gone.example/</loc></url> --><sm:sitemapindex xmlns:sm="http://x.example/0.9"><sm:sitemap><sm:lastmod>2024</sm:lastmod><sm:loc><![CDATA[https://h', CAST(c_custkey + 1 AS STRING), '.example/s.xml]]></sm:loc></sm:sitemap><!-- c --></sm:sitemapindex>')
    WHEN 1 THEN concat('<sm:urlset xmlns:sm="http://x.example/0.9" xmlns:im="http://y.example/"><sm:url><im:image><im:loc>https://image.example/</im:loc></im:image><sm:loc>https://a.example/?x=1&amp;y=', CAST(c_custkey AS STRING), '</sm:loc><sm:priority>high</sm:priority></sm:url><!-- <sm:url><sm:loc>https://gone.example/</sm:loc></sm:url> --><sm:url><sm:loc> <![CDATA[https://c.example/?a&b]]> </sm:loc><sm:changefreq>daily</sm:changefreq></sm:url></sm:urlset>')
    WHEN 2 THEN '<html><body>not a map</body></html>' WHEN 3 THEN '<urlset><url><loc>https://a.example/?x&y</loc></url></urlset>' ELSE '  ' END AS xml FROM {customer}""")
query("a2_tangled_sitemaps", lambda t: R.sitemap_urls(t.tangled_sitemaps).select("root", "url", "changefreq", "priority", "warning"), """
  SELECT 'https://h' || CASE WHEN k < 2 THEN c_custkey - 1 ELSE c_custkey END || '.example/s.xml' AS root, CASE k WHEN 0 THEN 'https://a.example/?x=1&y=' || c_custkey WHEN 1 THEN 'https://c.example/?a&b' END AS url, CASE WHEN k = 1 THEN 'daily' END AS changefreq, NULL::DOUBLE AS priority, CASE WHEN k = 2 THEN 'malformed sitemap' END AS warning
  FROM {customer}, (VALUES (0), (1), (2)) AS e(k) WHERE (c_custkey % 5 = 1 AND k < 2) OR (c_custkey % 5 = 3 AND k = 2)""")
fixture("templates", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('https://x.example/', CAST(c_custkey AS STRING), '?p={{{{1..5:2}}}}&c={{{{red, blue}}}}') WHEN 1 THEN 'https://x.example/{{{{1..3}}}}/{{{{a,b}}}}/{{{{-1..0}}}}/{{{{x,y}}}}' ELSE 'https://x.example/plain' END AS template FROM {customer}".replace("{{{{", "{{").replace("}}}}", "}}"))
query("a3_expand_url_templates", lambda t: R.expand_url_templates(t.templates), """
  SELECT id, 'https://x.example/' || id || '?p=' || p || '&c=' || c AS url FROM {templates}, (VALUES (1), (3), (5)) AS a(p), (VALUES ('red'), ('blue')) AS b(c) WHERE id % 3 = 0
  UNION ALL SELECT id, 'https://x.example/' || p || '/' || q || '/' || r || '/' || s FROM {templates}, (VALUES (1), (2), (3)) AS a(p), (VALUES ('a'), ('b')) AS b(q), (VALUES (-1), (0)) AS c(r), (VALUES ('x'), ('y')) AS d(s) WHERE id % 3 = 1 UNION ALL SELECT id, 'https://x.example/plain' FROM {templates} WHERE id % 3 = 2""")


def _round_trip(t, fmt: str):
    df = t.part.select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"))
    path = W.write_records(df, f"{new_folder(t.spark)}.{fmt}")
    reader = t.spark.read.schema(df.schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path) if fmt == "jsonl" else reader.parquet(path)


for _fmt in ("csv", "jsonl", "parquet"):
    query(f"a7_write_records_{_fmt}", lambda t, f=_fmt: _round_trip(t, f), "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size FROM {part}")


def _twice(t):
    root = new_folder(t.spark)
    first, _ = W.write_idempotent(t.part.select("p_partkey"), f"{root}/out", f"{root}/ledger", "k1")
    again, written = W.write_idempotent(t.part.select("p_partkey").limit(1), f"{root}/out", f"{root}/ledger", "k1")
    return t.spark.read.parquet(again).select("p_partkey", F.lit(first == again).alias("same_place"), F.lit(written).alias("written_again"))


query("a8_write_idempotent", _twice, "SELECT p_partkey, true AS same_place, false AS written_again FROM {part}")


def _history(t):
    path = new_folder(t.spark)
    W.append_run_history(t.part.select("p_partkey"), path, "q", "c1", "2024-01-01 00:00:00")
    return t.spark.read.parquet(path).select("client_id", F.get_json_object("data", "$.p_partkey").cast("long").alias("p_partkey"))


query("a11_append_run_history", _history, "SELECT 'c1' AS client_id, p_partkey FROM {part}")


def _report(t):
    folder = new_folder(t.spark)
    written = W.write_report_tables({"data": t.part.select("p_partkey"), "confidence": t.part.select("p_name"), "sources": t.supplier.select("s_suppkey", "s_name")}, folder)
    rows = [t.spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("row")) for name in written]
    return reduce(DataFrame.unionAll, rows)


query("a9_write_report_tables", _report, """
  SELECT 'data' AS name, '{"p_partkey":' || p_partkey || '}' AS row FROM {part} UNION ALL SELECT 'sources', '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' FROM {supplier}""")


def _whole_report(t):
    """The tables of a run over the orders fixtures, written and read back."""
    folder = new_folder(t.spark)
    report = Q.quality_report(t.cur, Q.QualityRules(required_fields=["title"]), F.lit("2024-02-02").cast("timestamp"))
    records = t.cur.select("title", "price", (F.col("seq") % 8 / 8).alias("price_confidence"))
    provenance = C.build_provenance(t.cur.select(F.col("title").alias("record_id"), "price"), F.lit("u"), F.lit("d"), "css", F.lit("2024-02-02").cast("date"))
    tables = W.run_report(records, V.classify_changes(t.prev, t.cur), provenance, report, Q.quality_verdict(report), {"run": "r1", "pages": 3, "note": None}, ["late page"])
    return t.spark, folder, W.write_report_tables(tables, folder)


def _report_sizes(t):
    spark, folder, names = _whole_report(t)
    return reduce(DataFrame.unionAll, [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")).select("name", "n") for n in names])


query("a9_report_sheets", _report_sizes, f"""
  WITH {_CHANGES} SELECT 'data' AS name, count(*) AS n FROM {{cur}} UNION ALL SELECT 'changes', count(*) FILTER (change_type IN ('NEW', 'REMOVED')) + sum(CASE WHEN change_type = 'MODIFIED' THEN CAST(dp AS INTEGER) + CAST(dn AS INTEGER) + CAST(da AS INTEGER) ELSE 0 END)::BIGINT FROM changes
  UNION ALL SELECT 'sources', count(*) FROM {{cur}} UNION ALL SELECT 'quality', 4 + 10 UNION ALL SELECT 'confidence', count(*) FROM {{cur}} UNION ALL SELECT 'run_summary', 3 UNION ALL SELECT 'errors', 1""")
query("a9_changes_sheet", lambda t: W.run_report(t.cur, V.classify_changes(t.prev, t.cur))["changes"], f"""
  WITH {_CHANGES} SELECT change_type AS status, identity, '' AS field, '' AS old, '' AS new FROM changes WHERE change_type IN ('NEW', 'REMOVED')
  UNION ALL SELECT 'MODIFIED', identity, 'price', op, np FROM changes WHERE dp UNION ALL SELECT 'MODIFIED', identity, 'note', on_, nn FROM changes WHERE dn UNION ALL SELECT 'MODIFIED', identity, 'availability', oa, na FROM changes WHERE da""")


def _upserted(t):
    path = new_folder(t.spark)
    K.create_table(t.stock_table, path, ["id"], 16)
    K.upsert_table(t.stock_updates, path, "seq", keep=["first_size"])
    return K.read_table(t.spark, path)


query("a10_upsert_table", _upserted, """
  WITH u AS (SELECT id, arg_max(name, seq) AS name, max(seq) AS seq, arg_min(first_size, seq) AS first_size FROM {stock_updates} GROUP BY id)
  SELECT coalesce(t.id, u.id) AS id, coalesce(u.seq, t.seq) AS seq, coalesce(u.name, t.name) AS name, coalesce(t.first_size, u.first_size) AS first_size FROM {stock_table} t FULL JOIN u ON t.id = u.id""")
