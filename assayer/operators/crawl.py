"""Link graphs of stored pages: links, filters, robots, reachability, frontiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import urls as U
from assayer.operators.markup import page_elements
from assayer.operators.ranks import until_limits
from assayer.sources.shared import new_folder

# States of a crawl target, phrases of pages that block robots.
STATES = ("DISCOVERED", "QUEUED", "FETCHING", "PROCESSED", "RETRY_WAIT", "SKIPPED", "FAILED", "POLICY_REFUSED")
TERMINAL, PENDING = ("PROCESSED", "SKIPPED", "FAILED", "POLICY_REFUSED"), ("QUEUED", "FETCHING", "RETRY_WAIT")
BLOCK_PHRASES = ("enable javascript", "javascript is disabled", "checking your browser", "just a moment", "attention required", "access denied", "request blocked", "are you a robot", "verify you are human", "unusual traffic", "automated queries")
#: Where a text file's lines end.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


@dataclass(frozen=True)
class LinkPolicy:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    same_domain: bool = True
    max_depth: int | None = None


def page_links(pages: DataFrame, hidden: bool = False) -> DataFrame:
    """(page_id, from_url, url): the absolute http(s) links of each page, without repeats within a page.

    Links that readers do not see (honeypots, links in comments or scripts) are left out unless hidden is set.
    """
    links = page_elements(pages, ("a",)).where("attrs['href'] <> ''")
    links = links if hidden else links.where("not hidden")
    found = links.select("page_id", F.col("url").alias("from_url"), U.resolve(F.trim(F.col("attrs")["href"]), F.col("url")).alias("url")).where("url is not null")
    return found.dropDuplicates(["page_id", "from_url", "url"])


def link_verdict(url: Column, from_url: Column, depth: Column, policy: LinkPolicy) -> Column:
    """The first of: scheme, exclusion, domain, inclusion, depth that speaks against a link; else `allowed`."""
    verdict = F.when(~U.part(url, 1).isin("http", "https"), "scheme_not_allowed")
    for pattern in policy.exclude:
        verdict = verdict.when(url.rlike(pattern), "excluded_by_pattern")
    if policy.same_domain:
        a, b = F.lower(U.part(F.coalesce(from_url, F.lit("")), 2)), F.lower(U.part(url, 2))
        verdict = verdict.when((a != "") & (b != "") & (a != b), "different_domain")
    if policy.include:
        some = F.lit(False)
        for pattern in policy.include:
            some = some | url.rlike(pattern)
        verdict = verdict.when(~some, "not_in_include_list")
    if policy.max_depth is not None:
        verdict = verdict.when(depth > policy.max_depth, "max_depth_exceeded")
    return verdict.otherwise("allowed")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, rules) from (host, text): the patterns that hold for an agent, the longest first and allow before disallow.

    The group that names the agent counts, else that of `*`. A rule is (n, deny, value, regex); regex is null where the
    value is a plain prefix. A list is as long as its robots.txt.
    """
    lines = robots.select("host", F.posexplode(F.split("text", LINE_ENDS)).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").contains(":"))
    told = lines.select("host", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value")).where("key in ('user-agent', 'allow', 'disallow')")
    by = Window.partitionBy("host").orderBy("n")  # the lines of one text
    starts = told.withColumn("new", ((F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by), F.lit("")) != "user-agent")).cast("int"))
    groups = starts.withColumn("g", F.sum("new").over(by))
    agents = groups.where("key = 'user-agent'").groupBy("host", "g").agg(F.collect_set(F.lower("value")).alias("agents"))
    fits = F.when(F.array_contains("agents", agent.lower()), 0).when(F.array_contains("agents", "*"), 1)
    chosen = agents.withColumn("fit", fits).where("fit is not null").groupBy("host").agg(F.min(F.struct("fit", "g")).alias("c")).select("host", F.col("c.g").alias("g"))
    body = F.regexp_replace(F.regexp_replace("value", r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.when(F.col("value").rlike(r"\*|\$$"), F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(F.col("value").endswith("$"), "$").otherwise("")))
    rule = F.struct((-F.length("value")).alias("n"), (F.col("key") == "disallow").alias("deny"), "value", regex.alias("regex"))
    live = groups.where("key <> 'user-agent' and value <> ''").join(chosen, ["host", "g"])
    return live.groupBy("host").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls (url, ...) with `allowed` by their host's robots.txt (host, text), row for row.

    The longest pattern that matches the path wins, allow on ties: the first of the host's rule list that fits. URLs meet one
    row per host; prefixes are compared as such, only patterns with * or $ as regular expressions.
    """
    path = F.concat(F.when(U.part(F.col("url"), 3) == "", "/").otherwise(U.part(F.col("url"), 3)), F.when(U.part(F.col("url"), 4) != "", F.concat(F.lit("?"), U.part(F.col("url"), 4))).otherwise(""))
    asked = urls.withColumns({"_host": U.host(F.col("url")), "_path": path}).join(robots_rules(robots, agent).withColumnRenamed("host", "_h"), F.col("_host") == F.col("_h"), "left")
    fits = lambda r: F.when(r["regex"].isNull(), F.startswith(F.col("_path"), r["value"])).otherwise(F.regexp_like(F.col("_path"), r["regex"]))
    first = F.get(F.filter("rules", fits), F.lit(0))
    return asked.withColumn("allowed", ~F.coalesce(first["deny"], F.lit(False))).drop("_host", "_path", "_h", "rules")


def crawl_bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None, policy: LinkPolicy | None = None) -> DataFrame:
    """(url, depth): what is reachable from seeds (url) over edges (from_url, url), breadth first.

    Both ends of a link are brought into canonical form, and links that the policy refuses at any depth are dropped,
    once before the first step; seeds are held to the same policy. Links and known URLs are tables bucketed by URL: the last
    depth meets its links where they are, its steps alone are shuffled, and are appended to what is known. max_pages keeps the first pages by depth and URL:
    pages are counted as depths are done, no depth is begun once there are enough, and only the last one is cut.
    """
    policy = policy or LinkPolicy(same_domain=False)
    spark, folder = edges.sparkSession, new_folder(edges.sparkSession)
    deepest = max_depth if policy.max_depth is None else min(max_depth, policy.max_depth)
    allowed = lambda a, b: link_verdict(b, a, F.lit(0), policy) == "allowed"
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"assayer_crawl_{folder.rsplit('/', 1)[-1]}"

    def keep(df: DataFrame, what: str, by: str, mode: str) -> None:
        df.write.mode(mode).bucketBy(buckets, by).sortBy(by).option("path", f"{folder}/{what}").saveAsTable(f"{name}_{what}")

    try:
        links = edges.select(U.canonical(F.col("from_url")).alias("from_url"), U.canonical(F.col("url")).alias("to_url"))
        keep(links.where(allowed(F.col("from_url"), F.col("to_url")) & (F.col("from_url") != F.col("to_url"))).distinct().repartition(buckets, "from_url"), "links", "from_url", "errorifexists")
        first = seeds.select(U.canonical(F.col("url")).alias("url")).where(allowed(F.lit(None).cast("string"), F.col("url"))).distinct().withColumn("depth", F.lit(0))
        keep(first.repartition(buckets, "url"), "known", "url", "errorifexists")
        depth, known = 0, spark.table(f"{name}_known").count()
        while depth < deepest and (max_pages is None or known < max_pages):
            seen = spark.table(f"{name}_known")
            frontier = seen.where(F.col("depth") == depth).select(F.col("url").alias("from_url"))
            steps = frontier.join(spark.table(f"{name}_links"), "from_url").select(F.col("to_url").alias("url")).distinct()
            depth += 1
            keep(steps.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "known", "url", "append")
            found = spark.table(f"{name}_known").where(F.col("depth") == depth).count()
            if not found:
                break
            known += found
    finally:  # the tables are external: their files stay
        for what in ("links", "known"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{what}")
    reached = spark.read.schema("url string, depth int").parquet(f"{folder}/known")
    if max_pages is None or known <= max_pages:
        return reached
    last = reached.where(F.col("depth") == depth)
    return reached.where(F.col("depth") < depth).unionAll(last.orderBy("url").limit(max_pages - (known - last.count())))


def frontier_stats(targets: DataFrame) -> DataFrame:
    """(state, n, pending) with zeros for the states that do not occur; pending: some target is queued, being fetched or waiting to be."""
    states = targets.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    counts = states.join(targets.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.withColumn("pending", F.max(F.col("state").isin(*PENDING) & (F.col("n") > 0)).over(Window.partitionBy()))  # one row per state


def frontier_states(outcomes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(url, state, attempts, delay_seconds) after all fetch outcomes (url, seq, ok, blocked).

    The first success or refusal ends a target; until then it waits to be tried again, with doubling delays up to 30
    seconds, and fails for good after max_attempts. Only a target's first max_attempts outcomes can count, so each
    task keeps no more of them.
    """
    n = F.row_number().over(Window.partitionBy("url").orderBy("seq"))
    tried = outcomes.withColumn("n", n).where(F.col("n") <= max_attempts)
    end = F.when(F.col("blocked"), F.struct("n", F.lit("POLICY_REFUSED").alias("state"))).when(F.col("ok"), F.struct("n", F.lit("PROCESSED").alias("state")))
    ends = tried.groupBy("url").agg(F.min(end).alias("e"), F.count("*").cast("int").alias("tried"))
    state = F.coalesce("e.state", F.when(F.col("tried") >= max_attempts, "FAILED").otherwise("RETRY_WAIT"))
    ends = ends.select("url", state.alias("state"), F.coalesce("e.n", "tried").alias("attempts"))
    return ends.withColumn("delay_seconds", F.when(F.col("state") == "RETRY_WAIT", F.least(F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(30.0))))


def promote_retries(targets: DataFrame, now: Column) -> DataFrame:
    """targets (state, retry_at): those whose wait is over, or that have no time to wait for, are QUEUED again."""
    due = (F.col("state") == "RETRY_WAIT") & F.coalesce(F.col("retry_at") <= now, F.lit(True))
    return targets.withColumns({"state": F.when(due, "QUEUED").otherwise(F.col("state")), "retry_at": F.when(~due, F.col("retry_at"))})


def frontier_resume(targets: DataFrame) -> DataFrame:
    """Targets to go on with after a stop: those in FETCHING are QUEUED again, finished ones (failed and refused ones too) are left out."""
    return targets.where(~F.col("state").isin(*TERMINAL)).withColumn("state", F.when(F.col("state") == "FETCHING", "QUEUED").otherwise(F.col("state")))


def crawl_budget_cut(pages: DataFrame, max_pages: int, max_bytes: int, max_seconds: float) -> DataFrame:
    """Per crawl the pages fetched before a limit is reached; (crawl_id, seq, bytes, seconds). A crawl may be all rows: see ranks.until_limits."""
    return until_limits(pages, "crawl_id", [F.asc("seq")], {"pages": (F.lit(1), max_pages), "bytes": ("bytes", max_bytes), "seconds": ("seconds", max_seconds)})


def blocked_pages(pages: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, blocked, reason): block phrases, then for pages of some size a missing title, headings or query terms."""
    low = F.lower("html")
    title = F.trim(F.regexp_extract(low, r"(?s)<title[^>]*>(.*?)</title>", 1))
    heading = low.rlike(r"(?s)<h[123][^>]*>[^<]*[^<\s]")
    visible = F.regexp_replace(F.regexp_replace(low, r"(?s)<(script|style|noscript)\b.*?</(script|style|noscript)>", " "), r"(?s)<[^>]*>", " ")
    reason = F.when(F.coalesce(F.col("html"), F.lit("")) == "", "empty html")
    for phrase in BLOCK_PHRASES:
        reason = reason.when(low.contains(phrase), f"block phrase: {phrase}")
    reason = reason.when(F.length("html") < 500, F.lit(None)).when(F.length(title) <= 3, "no meaningful title").when(~heading & ~low.contains("application/ld+json"), "no headings and no JSON-LD")
    if terms:
        some = F.lit(False)
        for t in terms:
            some = some | visible.contains(t.lower())
        reason = reason.when(~some, "query terms not present in visible text")
    return pages.select("page_id", reason.isNotNull().alias("blocked"), reason.alias("reason"))


def unchanged_pages(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(url, unchanged) of pages in both, equal after white space is collapsed; digests meet, not pages."""
    digest = F.sha2(F.trim(F.regexp_replace("html", r"\s+", " ")), 256)
    a, b = previous.select("url", digest.alias("a")), current.select("url", digest.alias("b"))
    return a.join(b, "url").select("url", (F.col("a") == F.col("b")).alias("unchanged"))
