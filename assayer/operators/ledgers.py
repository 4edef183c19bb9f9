"""Ledgers of jobs, batches, fetches, deliveries and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.ranks import numbered
from assayer.operators.versions import set_digest

# Status codes with their block kind, kinds after which the next provider is tried, failures worth a retry, job transitions, rung costs.
STATUS_KINDS = {200: "ok", 201: "ok", 202: "ok", 204: "ok", 206: "ok", 301: "redirect", 302: "redirect", 303: "redirect", 307: "redirect", 308: "redirect", 400: "bad_request", 401: "access_block", 402: "payment_required", 403: "access_block", 404: "not_found", 408: "timeout", 429: "rate_limit",
                500: "server_error", 502: "server_error", 503: "service_unavailable", 504: "service_unavailable"}
FALL_THROUGH = ("access_block", "rate_limit", "payment_required", "server_error", "service_unavailable", "timeout", "network_error", "provider_failure", "unknown")
RETRYABLE = ("TRANSIENT", "TIMEOUT", "HTTP_5XX", "RATE_LIMIT_TEMP", "BROWSER_START", "NETWORK")
DELAYS = (0.0, 2.0, 4.0, 8.0, 16.0)
ERROR_KINDS = (("timeout|timed out", "timeout"), ("rate limit|too many requests", "rate_limit"), ("402|insufficient", "payment_required"), ("403", "access_block"), ("404", "not_found"), ("503", "service_unavailable"), ("connection|connect|network|dns|resolve|unreachable|reset by peer", "network_error"))
TRANSITIONS = {
    "DRAFT": "QUEUED CANCELLED", "QUEUED": "PLANNING CANCELLED", "PLANNING": "RUNNING FAILED CANCELLED", "RUNNING": "RECOVERING VALIDATING FAILED PAUSED_BY_CIRCUIT_BREAKER CANCELLED SUCCEEDED_WITH_WARNINGS", "RECOVERING": "RUNNING FAILED CANCELLED",
    "VALIDATING": "SUCCEEDED SUCCEEDED_WITH_WARNINGS QUALITY_FAILED FAILED", "QUALITY_FAILED": "QUARANTINED CANCELLED RUNNING", "QUARANTINED": "RUNNING CANCELLED", "PAUSED_BY_CIRCUIT_BREAKER": "RUNNING CANCELLED FAILED", "FAILED": "QUEUED", "SUCCEEDED": "", "SUCCEEDED_WITH_WARNINGS": "", "CANCELLED": ""}
ENDED = ("SUCCEEDED", "SUCCEEDED_WITH_WARNINGS", "FAILED", "CANCELLED", "QUALITY_FAILED", "QUARANTINED")
WEBHOOK_BACKOFF = (60, 300, 1800)


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def batch_progress(batches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per batch: chunk counts, progress, and the state that follows from them."""
    n = {s: F.count_if(F.col("state") == s).alias(s.lower()) for s in ("SUCCEEDED", "FAILED", "PAUSED", "RUNNING")}
    counts = chunks.groupBy("batch_id").agg(F.count("*").alias("total"), *n.values())
    done = F.col("succeeded") + F.col("failed")
    state = F.when(F.col("total") == 0, "PENDING").when(F.col("succeeded") == F.col("total"), "SUCCEEDED").when(F.col("failed") == F.col("total"), "FAILED").when(done == F.col("total"), "PARTIAL").when(F.col("paused") > 0, "PAUSED").when((done > 0) | (F.col("running") > 0), "RUNNING").otherwise("PENDING")
    joined = batches.select("batch_id").join(counts, "batch_id", "left").fillna(0)
    return joined.withColumn("progress", F.when(F.col("total") > 0, done / F.col("total")).otherwise(0.0)).withColumn("derived_state", state)


def batch_result(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """Records of succeeded chunks in chunk order, with `complete`; strict: only of complete batches. chunks carry an array `records`."""
    whole = chunks.groupBy("batch_id").agg(F.bool_and(F.col("state") == "SUCCEEDED").alias("complete"))
    rows = chunks.where("state = 'SUCCEEDED'").select("batch_id", "index", F.posexplode("records").alias("pos", "record")).join(whole, "batch_id")
    return rows.where("complete") if strict else rows


def chunk_urls(urls: DataFrame, size: int = 100) -> DataFrame:
    """(batch_id, url, chunk): trimmed, without empty and repeated URLs, in the order of seq."""
    clean = urls.withColumn("url", F.trim("url")).where("url <> ''").groupBy("batch_id", "url").agg(F.min("seq").alias("seq"))
    placed = numbered(clean, "batch_id", [F.asc("seq"), F.asc("url")])
    return placed.select("batch_id", "url", F.floor((F.col("place") - 1) / size).cast("int").alias("chunk"))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """(state, priority, n): counts by state, by priority, and of all, in one pass of grouping sets."""
    return jobs.groupingSets([["state"], ["priority"], []], "state", "priority").agg(F.count("*").alias("n"))


def dead_letters(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.where("state = 'DEAD_LETTER'").orderBy(F.desc("created_at"), "job_id").limit(n)


def lease_order(jobs: DataFrame, buckets: str = "queue") -> DataFrame:
    """Queued jobs of each queue with their place: by priority, then age."""
    return numbered(jobs.where("state = 'QUEUED'"), buckets, [F.asc("priority"), F.asc("created_at"), F.asc("job_id")])


def expired_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """The ledger after a sweep: expired leases go back to the queue, or to dead letters at their last attempt."""
    expired = F.col("state").isin("LEASED", "RUNNING") & (F.col("lease_expires_at") < now)
    state = F.when(expired, F.when(F.col("attempts") >= F.col("max_attempts"), "DEAD_LETTER").otherwise("QUEUED")).otherwise(F.col("state"))
    return jobs.withColumns({"state": state, "recovered": F.coalesce(expired, F.lit(False))})


def job_transitions(log: DataFrame) -> DataFrame:
    """Each state change (job_id, at, seq, state) with its predecessor, whether it is allowed, and seconds since the job began."""
    w = Window.partitionBy("job_id").orderBy("at", "seq")
    allowed = F.array_contains(F.split(_map(TRANSITIONS, F.lag("state").over(w)), " "), F.col("state"))
    first = F.first("at").over(w)
    return log.withColumn("previous", F.lag("state").over(w)).withColumn("allowed", F.when(F.lag("state").over(w).isNull(), True).otherwise(F.coalesce(allowed, F.lit(False)))).withColumn(
        "since_start", F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))).withColumn("terminal", F.col("state").isin(*ENDED))


def fetch_health(log: DataFrame) -> DataFrame:
    """fetch log (status_code, error) with block_kind and whether the next provider is tried."""
    code, low = F.col("status_code"), F.lower(F.coalesce("error", F.lit("")))
    by_error = F.when(low == "", F.lit(None))
    for pattern, kind in ERROR_KINDS:
        by_error = by_error.when(low.rlike(pattern), kind)
    by_code = F.coalesce(_map(STATUS_KINDS, code), F.when(code.between(200, 299), "ok").when(code.between(300, 399), "redirect").when(code.between(400, 499), "bad_request").when(code.between(500, 599), "server_error").when(code.isNull(), "network_error").otherwise("unknown"))
    kind = F.coalesce(by_error.otherwise("provider_failure"), by_code)
    return log.withColumn("block_kind", kind).withColumn("fall_through", F.col("block_kind").isin(*FALL_THROUGH))


def block_rates(log: DataFrame, *keys: str) -> DataFrame:
    return fetch_health(log).groupBy(*keys).agg(F.count("*").alias("fetches"), F.avg(F.col("fall_through").cast("double")).alias("block_rate"))


def provider_credits(log: DataFrame) -> DataFrame:
    provider = F.coalesce(F.when(F.trim("provider") != "", F.lower(F.trim("provider"))), F.lit("unknown"))
    return log.groupBy(provider.alias("provider")).agg(F.count("*").alias("calls"), F.sum(F.greatest(F.coalesce("credits_used", F.lit(0)), F.lit(0))).alias("credits"))


def retry_plan(failures: DataFrame, max_attempts: int = 4) -> DataFrame:
    """Adds retry, attempts_left and delay_seconds to failures (failure_type, attempts)."""
    worth = F.upper("failure_type").isin(*RETRYABLE)
    left = F.greatest(F.lit(max_attempts) - F.col("attempts"), F.lit(0))
    attempt = F.col("attempts") + 1
    delay = F.when(attempt <= len(DELAYS), F.get(F.array(*map(F.lit, DELAYS)), F.greatest(attempt - 1, F.lit(0)).cast("int"))).otherwise(F.least(F.lit(60.0), 2.0 * F.pow(F.lit(2.0), attempt - 2)))
    return failures.withColumn("retry", worth & (left > 0)).withColumn("attempts_left", F.when(worth, left).otherwise(0)).withColumn("delay_seconds", F.when(F.col("retry"), delay))


def failure_clusters(experiences: DataFrame) -> DataFrame:
    return experiences.where("failure_class <> ''").groupBy("domain", "failure_class").agg(F.count("*").alias("n"))


def strategy_gate(runs: DataFrame, least_records: float = 1, least_runs: int = 3, least_schema: float = 0.95, completeness_drop: float = 0.02, duplicate_rise: float = 0.01, cost_ratio: float = 1.2, latency_ratio: float = 1.3) -> DataFrame:
    """Per domain: whether the candidate runs pass against the baseline runs, and the first reason against it.

    runs (domain, side baseline/candidate, records, schema_pass, flags, completeness, duplicates, cost, latency):
    both sides come from one aggregate.
    """
    names = ("records", "schema_pass", "completeness", "duplicates", "cost", "latency")
    side = lambda s: [F.avg(F.when(F.col("side") == s, F.col(c))).alias(f"{s[0]}_{c}") for c in names]
    g = runs.groupBy("domain").agg(*side("baseline"), *side("candidate"), F.count_if(F.col("side") == "candidate").alias("runs"), F.coalesce(F.sum(F.when(F.col("side") == "candidate", F.col("flags"))), F.lit(0)).alias("flags"))
    reason = (F.when(F.coalesce("c_records", F.lit(0.0)) < least_records, "records").when(F.col("runs") < least_runs, "runs").when(F.col("c_schema_pass") < least_schema, "schema").when(F.col("flags") > 0, "compliance")
              .when(F.col("c_completeness") - F.col("b_completeness") < -completeness_drop, "completeness").when(F.col("c_duplicates") - F.col("b_duplicates") > duplicate_rise, "duplicates")
              .when((F.col("b_cost") > 0) & (F.col("c_cost") / F.col("b_cost") > cost_ratio), "cost").when((F.col("b_latency") > 0) & (F.col("c_latency") / F.col("b_latency") > latency_ratio), "latency"))
    return g.select("domain", "runs", reason.isNull().alias("passed"), F.coalesce(reason, F.lit("passed")).alias("reason"))


def strategy_rollback(runs: DataFrame, rollbacks: DataFrame, now: Column, drop: float = 0.15, floor: float = 0.5, days: int = 7) -> DataFrame:
    """Domains to roll back: success of the last day against the `days` before it, or quality below the floor; not within `days` of the last one."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))) / 86400
    g = runs.groupBy("domain").agg(F.avg(F.when(age <= 1, F.col("ok").cast("double"))).alias("now_rate"), F.avg(F.when((age > 1) & (age <= days + 1), F.col("ok").cast("double"))).alias("base_rate"), F.avg(F.when(age <= 1, F.col("quality"))).alias("quality"))
    last = rollbacks.groupBy("domain").agg(F.max("at").alias("last"))
    cool = F.coalesce(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp")) < days * 86400, F.lit(False))
    reason = F.when(F.col("base_rate") > 0, F.when((F.col("base_rate") - F.col("now_rate")) / F.col("base_rate") > drop, "success rate dropped"))
    reason = F.coalesce(reason, F.when(F.col("quality") < floor, "quality below floor"))
    return g.join(last, "domain", "left").withColumn("reason", reason).where(~cool & F.col("reason").isNotNull()).select("domain", "reason")


def healing_circuit(attempts: DataFrame, most: int = 3) -> DataFrame:
    return attempts.groupBy("run_id", "domain").agg(F.count("*").alias("attempts")).withColumn("tripped", F.col("attempts") >= most)


def healing_report(attempts: DataFrame, costs: dict[str, float]) -> DataFrame:
    """Per domain and rung: attempts, recoveries, records, cost; terminal and non-extraction failures are left out."""
    live = attempts.where("not terminal and is_extraction")
    cost = F.coalesce(_map(costs, F.col("rung")), F.lit(0.0))
    return live.groupBy("domain", "rung").agg(F.count("*").alias("attempted"), F.count_if("recovered").alias("recovered"), F.sum("records").alias("records"), F.sum(F.when(F.col("recovered"), cost)).alias("_won"), F.sum(cost).alias("_all")).withColumn("cost", F.coalesce("_won", "_all")).drop("_won", "_all")


def delivery_status(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Per delivery: delivered on a 2xx, failed when attempts are used up, else pending with the next time to try."""
    g = attempts.groupBy("delivery_id").agg(F.count("*").alias("attempts"), F.max(F.struct("at", "seq", "status_code")).alias("last"))
    ok = F.col("last.status_code").between(200, 299)
    status = F.when(F.coalesce(ok, F.lit(False)), "delivered").when(F.col("attempts") >= most, "failed").otherwise("pending")
    wait = F.get(F.array(*map(F.lit, WEBHOOK_BACKOFF)), (F.least(F.col("attempts"), F.lit(len(WEBHOOK_BACKOFF))) - 1).cast("int"))
    return g.select("delivery_id", "attempts", status.alias("status"), F.when(status == "pending", F.unix_seconds(F.col("last.at").cast("timestamp")) + wait).alias("next_try_epoch"))


def audit_run_times(log: DataFrame) -> DataFrame:
    """Per query of the audit log (query, event, at, details json): runs, failures, elapsed seconds from start to last end."""
    details = F.from_json("details", "elapsed double")["elapsed"]
    ended = F.col("event").isin("completed", "failed")
    return log.groupBy("query").agg(F.count_if(F.col("event") == "started").alias("started"), F.count_if(F.col("event") == "failed").alias("failed"), F.avg(F.when(ended, details)).alias("mean_elapsed"),
                                    (F.unix_seconds(F.max(F.when(ended, F.col("at"))).cast("timestamp")) - F.unix_seconds(F.min(F.when(F.col("event") == "started", F.col("at"))).cast("timestamp"))).alias("span_seconds"))


def adaptive_timeouts(failures: DataFrame, default: int = 60_000, step: int = 30_000, most: int = 120_000) -> DataFrame:
    """Each failure (domain, seq) with the timeout that follows it."""
    placed = numbered(failures, "domain", [F.asc("seq")], "_n")
    return placed.withColumn("timeout_ms", F.least(F.lit(most), F.lit(default) + F.col("_n") * step).cast("long")).drop("_n")


def run_receipt(pages: DataFrame) -> DataFrame:
    """Per run: pages attempted, succeeded, failed, records, sources, seconds, and a digest of the page ids that is free of order."""
    ids = set_digest(F.sha2(F.col("page_id").cast("string"), 256))
    return pages.groupBy("run_id").agg(F.count("*").alias("attempted"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("records").alias("records"), F.count_distinct("source").alias("sources"),
                                       (F.unix_seconds(F.max("at").cast("timestamp")) - F.unix_seconds(F.min("at").cast("timestamp"))).alias("seconds"), ids.alias("digest"))


def tenant_scope(df: DataFrame, members: DataFrame, user: str, roles: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose client the user belongs to, with one of the roles if any are given (delete: owner, admin)."""
    mine = members.where(F.col("user_id") == user)
    mine = mine.where(F.col("role").isin(*roles)) if roles else mine
    return df.join(mine.select("client_id"), "client_id", "left_semi")
