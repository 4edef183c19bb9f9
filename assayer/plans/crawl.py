"""Queries on URLs, links and crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import urls as U
from assayer.operators import crawl as C
from assayer.plans.base import fixture, query

fixture("odd_urls", """
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat(url, CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'utm_medium=x&b=2&a=1&gclid=9') WHEN 1 THEN replace(url, '.example.', '.EXAMPLE.') WHEN 2 THEN replace(url, '/en/', '/en/../x/./') WHEN 3 THEN replace(replace(url, '.net/', '.net:443/'), '.com/', '.com:80/') ELSE url END AS url FROM {pages}""")
_P = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_CANON = f"""(lower(regexp_extract(url, {_P}, 1)) || '://' || CASE lower(regexp_extract(url, {_P}, 1)) WHEN 'http' THEN regexp_replace(lower(regexp_extract(url, {_P}, 2)), ':80$', '') ELSE regexp_replace(lower(regexp_extract(url, {_P}, 2)), ':443$', '') END
  || replace(CASE WHEN regexp_extract(url, {_P}, 3) = '' THEN '/' ELSE regexp_extract(url, {_P}, 3) END, '/en/../x/./', '/x/')
  || coalesce('?' || nullif(array_to_string(list_sort(list_transform(list_filter(string_split(split_part(split_part(url, '#', 1), '?', 2), '&'), lambda kv: kv <> '' AND NOT starts_with(lower(kv), 'utm_') AND split_part(lower(kv), '=', 1) NOT IN ({', '.join(f"'{x}'" for x in U.TRACKING)})), lambda kv: CASE WHEN contains(kv, '=') THEN kv ELSE kv || '=' END)), '&'), ''), ''))"""
query("h7_canonicalize_urls", lambda t: t.odd_urls.select("page_id", U.canonical(F.col("url")).alias("canonical")), f"SELECT page_id, {_CANON} AS canonical FROM {{odd_urls}}")
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["'']([^"''<>]*)["'']"""
_LINKS = f"""links AS (SELECT DISTINCT page_id, url AS from_url, CASE WHEN starts_with(href, '/') THEN regexp_extract(lower(url), '^([a-z]+://)', 1) || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || href END AS url
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href FROM {{pages}}) WHERE starts_with(href, '/'))"""
query("k4_page_links", lambda t: C.page_links(t.pages), f"WITH {_LINKS} SELECT page_id, from_url, url FROM links")
fixture("tangled_pages", """
  SELECT page_id, url, concat('<body><a href=/u', CAST(page_id AS STRING), '>u</a><a title="x>y" href=', chr(39), '/late', CAST(page_id AS STRING), chr(39), '>l</a><!-- <a href="/gone">g</a> --><a HREF="/q?a=1&amp;b=', CAST(page_id AS STRING), '">q</a><script>var s = "<a href=/s>";</script>',
    '<a href="/h" style=display:none>h</a><p aria-hidden="true"><a href="/aria">x</a></p><a class="sr-only" style="left:-9999px" href="/spoken">Skip</a><a name="n">no</a><a href="">e</a><a href="//cdn.example/x">c</a><a href="mailto:a@b.c">m</a><a href="/open">one<a href="/next">two<a href="/open">three</body>') AS html FROM {pages}""")
_ROOT = "regexp_extract(lower(url), '^([a-z]+://)', 1) || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
query("k4_tangled_links", lambda t: C.page_links(t.tangled_pages), f"""
  SELECT page_id, url AS from_url, CASE WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z]+):', 1) || ':' || h ELSE {_ROOT} || h END AS url FROM (
    SELECT page_id, url, unnest(['/u' || page_id, '/late' || page_id, '/q?a=1&b=' || page_id, '/spoken', '//cdn.example/x', '/open', '/next']) AS h FROM {{tangled_pages}})""")
query("k4_hidden_links", lambda t: C.page_links(t.tangled_pages, hidden=True).join(C.page_links(t.tangled_pages), ["page_id", "from_url", "url"], "left_anti"), f"""
  SELECT page_id, url AS from_url, {_ROOT} || unnest(['/h', '/aria']) AS url FROM {{tangled_pages}}""")
_POLICY = C.LinkPolicy(include=("/(the|The|[a-d])",), exclude=("ing$",), max_depth=2)
query("b1_filter_links", lambda t: C.page_links(t.pages).withColumn("depth", (F.col("page_id") % 4).cast("int")).select("page_id", "url", C.link_verdict(F.col("url"), F.when(F.col("page_id") % 5 == 0, "https://other.example/").otherwise(F.col("from_url")), F.col("depth"), _POLICY).alias("verdict")),
      f"WITH {_LINKS} SELECT page_id, url, CASE WHEN regexp_matches(url, 'ing$') THEN 'excluded_by_pattern' WHEN page_id % 5 = 0 THEN 'different_domain' WHEN NOT regexp_matches(url, '/(the|The|[a-d])') THEN 'not_in_include_list' WHEN page_id % 4 > 2 THEN 'max_depth_exceeded' ELSE 'allowed' END AS verdict FROM links")
fixture("fetch_urls", """
  SELECT o_orderkey AS seq, CASE o_orderkey % 14 WHEN 0 THEN 'ftp://a.example/x' WHEN 1 THEN 'http://user@a.example/' WHEN 2 THEN 'http:///x' WHEN 3 THEN 'http://printer.local/x' WHEN 4 THEN 'http://169.254.169.254/meta' WHEN 5 THEN concat('http://10.', CAST(o_custkey % 250 AS STRING), '.3.4/')
    WHEN 6 THEN concat('http://', CAST(o_orderkey % 256 AS STRING), '.20.1.9:8080/p') WHEN 7 THEN 'http://192.168.1.1' WHEN 8 THEN 'http://0.0.0.0/' WHEN 9 THEN 'https://metadata.goog/v1' WHEN 10 THEN '' WHEN 11 THEN 'http://127.0.0.1/' ELSE concat('https://shop', CAST(o_custkey AS STRING), '.example/item') END AS url FROM {orders}""")
query("b2_filter_unsafe_urls", lambda t: t.fetch_urls.select("seq", U.unsafe_reason(F.col("url")).alias("reason")), """
  SELECT seq, CASE o WHEN 0 THEN 'scheme not allowed' WHEN 1 THEN 'userinfo in URL' WHEN 2 THEN 'no hostname' WHEN 3 THEN 'forbidden hostname suffix: .local' WHEN 4 THEN 'cloud metadata endpoint' WHEN 5 THEN 'IP literal in private range'
    WHEN 6 THEN CASE WHEN a = 127 THEN 'IP literal in loopback range' WHEN a BETWEEN 224 AND 239 THEN 'IP literal in multicast range' WHEN a >= 240 THEN 'IP literal in reserved range' WHEN a = 10 THEN 'IP literal in private range' WHEN a = 172 THEN 'IP literal in private range' WHEN a = 0 THEN 'IP literal in reserved range' END
    WHEN 7 THEN 'IP literal in private range' WHEN 8 THEN 'IP literal in reserved range' WHEN 9 THEN 'cloud metadata endpoint' WHEN 10 THEN 'empty URL' WHEN 11 THEN 'IP literal in loopback range' END AS reason FROM (SELECT seq, seq % 14 AS o, seq % 256 AS a FROM {fetch_urls})""")

fixture("robots", "SELECT concat('h', CAST(c_custkey AS STRING), '.example') AS host, concat('# rules', chr(10), 'User-agent: other', chr(10), 'Disallow: /', chr(10), 'User-agent: *', chr(10), 'Disallow: /private', chr(10), CASE WHEN c_custkey % 2 = 0 THEN 'Allow: /private/open' ELSE 'Disallow: /*.pdf$' END, chr(10), 'Disallow:', chr(10), 'Sitemap: x') AS text FROM {customer} WHERE c_acctbal > 0")
fixture("robot_urls", "SELECT DISTINCT concat('https://h', CAST(o_custkey AS STRING), '.example', CASE o_orderkey % 7 WHEN 0 THEN '/private/a' WHEN 1 THEN '/private/open/b' WHEN 2 THEN '/doc.pdf' WHEN 3 THEN '/doc.pdf?x=1' WHEN 4 THEN '' ELSE '/ok' END) AS url FROM {orders}")
query("c4_robots_filter", lambda t: C.robots_filter(t.robot_urls, t.robots), """
  SELECT url, CASE WHEN c_custkey IS NULL THEN true WHEN h % 2 = 0 THEN NOT starts_with(p, '/private') OR starts_with(p, '/private/open') ELSE NOT (starts_with(p, '/private') OR regexp_matches(p, '[.]pdf$')) END AS allowed
  FROM (SELECT url, CAST(regexp_extract(url, 'h([0-9]+)[.]', 1) AS BIGINT) AS h, regexp_extract(url, '^https://[^/]+(.*)$', 1) AS p FROM {robot_urls}) LEFT JOIN {customer} ON c_custkey = h AND c_acctbal > 0""")

fixture("site_links", """
  SELECT concat('https://S.example:443/p/', CAST(c_custkey AS STRING), CASE c_custkey % 3 WHEN 0 THEN '?utm_source=y' WHEN 1 THEN '#top' ELSE '' END) AS from_url, concat('https://S.example/p/', CAST((c_custkey * 7 + 3) % 1500 AS STRING), '#x') AS url FROM {customer}
  UNION ALL SELECT concat('https://s.example/p/', CAST(c_custkey AS STRING)), concat('https://s.example/p/', CAST((c_custkey * 11 + 5) % 1500 AS STRING), '?utm_source=z') FROM {customer}""")
fixture("seeds", "SELECT concat('HTTPS://s.example/p/', CAST(n_nationkey AS STRING), '#seed') AS url FROM {nation} WHERE n_nationkey < 3")
query("c5_crawl_bfs", lambda t: C.crawl_bfs(t.site_links, t.seeds, 4), """
  WITH RECURSIVE reach AS (SELECT CAST(regexp_extract(url, '([0-9]+)#seed$', 1) AS BIGINT) AS k, 0 AS depth FROM {seeds}
    UNION SELECT (k * m + a) % 1500, depth + 1 FROM reach JOIN {customer} ON c_custkey = k, (VALUES (7, 3), (11, 5)) AS f(m, a) WHERE depth < 4)
  SELECT 'https://s.example/p/' || k AS url, min(depth) AS depth FROM reach GROUP BY k""")
query("c5_crawl_max_pages", lambda t: C.crawl_bfs(t.site_links, t.seeds, 6, max_pages=20), """
  WITH RECURSIVE reach AS (SELECT CAST(regexp_extract(url, '([0-9]+)#seed$', 1) AS BIGINT) AS k, 0 AS depth FROM {seeds}
    UNION SELECT (k * m + a) % 1500, depth + 1 FROM reach JOIN {customer} ON c_custkey = k, (VALUES (7, 3), (11, 5)) AS f(m, a) WHERE depth < 6)
  SELECT 'https://s.example/p/' || k AS url, min(depth) AS depth FROM reach GROUP BY k ORDER BY depth, url LIMIT 20""")
fixture("agent_robots", """SELECT concat('h', CAST(c_custkey AS STRING), '.example') AS host, concat('User-agent: a', chr(13), chr(10), 'User-Agent: Bot # us', chr(10), 'Disallow: /x*y$', chr(13), 'Allow: /x1y', chr(10), 'Disallow: /q?a=', chr(10), 'Allow: /', chr(10), 'Disallow: /', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '*.gif' END, chr(10), 'User-agent: *', chr(10), 'Disallow: /') AS text FROM {customer}""")
fixture("agent_urls", "SELECT o_orderkey AS seq, concat('https://u@H', CAST(o_custkey AS STRING), '.example:443', CASE o_orderkey % 8 WHEN 0 THEN '/x2y' WHEN 1 THEN '/x1y' WHEN 2 THEN '/x2yz' WHEN 3 THEN '/q?a=1' WHEN 4 THEN '/q?b=1' WHEN 5 THEN '/a.gif' WHEN 6 THEN '/a.gif?x' ELSE '' END) AS url FROM {orders}")
query("c4_robots_for_an_agent", lambda t: C.robots_filter(t.agent_urls, t.agent_robots, "bot"), """
  SELECT seq, url, CASE seq % 8 WHEN 0 THEN false WHEN 1 THEN false WHEN 3 THEN false WHEN 5 THEN h % 2 = 0 WHEN 6 THEN h % 2 = 0 ELSE true END AS allowed FROM (SELECT seq, url, CAST(regexp_extract(url, 'H([0-9]+)[.]', 1) AS BIGINT) AS h FROM {agent_urls}) JOIN {customer} ON c_custkey = h
  UNION ALL SELECT seq, url, true FROM {agent_urls} WHERE CAST(regexp_extract(url, 'H([0-9]+)[.]', 1) AS BIGINT) NOT IN (SELECT c_custkey FROM {customer})""")


fixture("crawl_targets", "SELECT concat('u', CAST(o_orderkey AS STRING)) AS url, CASE o_orderkey % 7 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'FETCHING' WHEN 2 THEN 'PROCESSED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'SKIPPED' WHEN 5 THEN 'RETRY_WAIT' ELSE 'POLICY_REFUSED' END AS state, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS retry_at FROM {orders}")
query("d25_frontier_stats", lambda t: C.frontier_stats(t.crawl_targets), """
  SELECT s AS state, (SELECT count(*) FROM {crawl_targets} WHERE state = s) AS n, (SELECT count(*) > 0 FROM {crawl_targets} WHERE state IN ('QUEUED', 'FETCHING', 'RETRY_WAIT')) AS pending
  FROM (SELECT unnest(['DISCOVERED', 'QUEUED', 'FETCHING', 'PROCESSED', 'RETRY_WAIT', 'SKIPPED', 'FAILED', 'POLICY_REFUSED']) AS s)""")
query("i8_frontier_resume", lambda t: C.frontier_resume(t.crawl_targets).select("url", "state"), "SELECT url, CASE state WHEN 'FETCHING' THEN 'QUEUED' ELSE state END AS state FROM {crawl_targets} WHERE state IN ('QUEUED', 'FETCHING', 'RETRY_WAIT')")
query("i8_promote_retries", lambda t: C.promote_retries(t.crawl_targets, F.lit("1998-01-01").cast("timestamp_ntz")).select("url", "state", F.col("retry_at").isNull().alias("no_wait")), """
  SELECT url, CASE WHEN due THEN 'QUEUED' ELSE state END AS state, retry_at IS NULL OR due AS no_wait FROM (SELECT *, state = 'RETRY_WAIT' AND coalesce(retry_at <= TIMESTAMP '1998-01-01', true) AS due FROM {crawl_targets})""")
fixture("fetch_outcomes", "SELECT concat('u', CAST(user_id * 13 + event_id % 13 AS STRING)) AS url, event_id AS seq, event_type = 'view' AS ok, event_type = 'error' AND event_id % 4 = 0 AS blocked FROM {events}")
query("i6_frontier_states", lambda t: C.frontier_states(t.fetch_outcomes), """
  WITH n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS k FROM {fetch_outcomes}),
  g AS (SELECT url, count(*) AS n, min(k) FILTER (ok OR blocked) AS e, arg_min(blocked, k) FILTER (ok OR blocked) AS b FROM n GROUP BY url)
  SELECT url, CASE WHEN e <= 3 THEN CASE WHEN b THEN 'POLICY_REFUSED' ELSE 'PROCESSED' END WHEN n >= 3 THEN 'FAILED' ELSE 'RETRY_WAIT' END AS state, CAST(least(3, CASE WHEN e IS NULL THEN n ELSE e END) AS INTEGER) AS attempts,
         CASE WHEN coalesce(e, 4) > 3 AND n < 3 THEN least(30.0, pow(2.0, n - 1)) END AS delay_seconds FROM g""")
fixture("crawled", "SELECT user_id AS crawl_id, event_id AS seq, CAST(round(value) AS BIGINT) AS bytes, event_id % 7 AS seconds FROM {events}")
query("e2_crawl_budget_cut", lambda t: C.crawl_budget_cut(t.crawled, 40, 1500, 100), """
  SELECT crawl_id, seq, bytes, seconds FROM (SELECT *, count(*) OVER w AS n, coalesce(sum(bytes) OVER w, 0) AS b, coalesce(sum(seconds) OVER w, 0) AS s FROM {crawled} WINDOW w AS (PARTITION BY crawl_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n < 40 AND b < 1500 AND s < 100""")
fixture("stored_pages", "SELECT page_id, url, CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN concat('<p>Please verify you are human</p>', html) WHEN 2 THEN replace(html, 'h1>', 'p>') WHEN 3 THEN '<p>short</p>' WHEN 4 THEN regexp_replace(html, '<title>[^<]*</title>', '') ELSE html END AS html FROM {pages}")
_PHRASES = " ".join(f"WHEN contains(lower(html), '{p}') THEN 'block phrase: {p}'" for p in C.BLOCK_PHRASES)
query("k8_blocked_pages", lambda t: C.blocked_pages(t.stored_pages), rf"""
  SELECT page_id, reason IS NOT NULL AS blocked, reason FROM (SELECT page_id, CASE WHEN html = '' THEN 'empty html' {_PHRASES} WHEN length(html) < 500 THEN NULL WHEN length(trim(regexp_extract(lower(html), '(?s)<title[^>]*>(.*?)</title>', 1))) <= 3 THEN 'no meaningful title'
    WHEN NOT regexp_matches(lower(html), '(?s)<h[123][^>]*>[^<]*[^<\s]') AND NOT contains(lower(html), 'application/ld+json') THEN 'no headings and no JSON-LD' END AS reason FROM {{stored_pages}})""")
fixture("later_pages", "SELECT url, CASE WHEN page_id % 3 = 0 THEN concat(html, '!') WHEN page_id % 3 = 1 THEN concat(replace(html, '><', '> <'), '') ELSE concat('  ', html, '  ') END AS html FROM {pages}")
query("g3_unchanged_pages", lambda t: C.unchanged_pages(t.pages, t.later_pages), r"SELECT p.url, trim(regexp_replace(p.html, '\s+', ' ', 'g')) = trim(regexp_replace(l.html, '\s+', ' ', 'g')) AS unchanged FROM {pages} p JOIN {later_pages} l ON p.url = l.url")
