"""Alert rules over job events, cooldowns, routing, incidents and service levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Conditions with the event kind and the payload value they test, severities in order, statuses that end an incident.
CONDITIONS = {
    "job_failed": ("job_failed", None, None), "quality_below": ("job_completed", "quality_score", "<"), "confidence_collapse": ("job_completed", "confidence_mean", "<"),
    "record_count_drop": ("job_completed", "records", "<"), "record_count_rise": ("job_completed", "records", ">"), "circuit_breaker_trip": ("circuit_breaker_trip", None, None),
    "self_healing_event": ("self_healing_event", None, None), "schema_change": ("schema_changed", None, None), "source_conflict_spike": ("job_completed", "conflicts", ">="),
    "budget_threshold": ("budget_event", "pct", ">="), "unexpected_removals": ("change_detected", "removed", ">="), "repeated_job_failure": ("job_failed", "recent_failures", ">="),
}
SEVERITIES, ENDED = ("info", "warning", "critical"), ("resolved", "closed")
FAILURE_CLASSES = {"job_failed": "unknown", "repeated_job_failure": "unknown", "record_count_drop": "data_quality", "record_count_rise": "data_quality", "quality_below": "data_quality", "confidence_collapse": "data_quality", "source_conflict_spike": "data_quality",
                   "unexpected_removals": "data_quality", "schema_change": "schema", "budget_threshold": "budget", "circuit_breaker_trip": "budget", "self_healing_event": "infrastructure"}
_PAYLOAD = "quality_score double, confidence_mean double, records double, conflicts double, pct double, removed double"


def message(condition: Column, payload: Column, job_id: Column, domain: Column, threshold: Column, recent_failures: Column) -> Column:
    """What a fired alert says, by its condition; numbers to two places, halves to even."""
    body, at = F.from_json(payload, _PAYLOAD), threshold.cast("int").cast("string")
    whole = lambda c: F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    text = lambda name, default: F.coalesce(F.get_json_object(payload, f"$.{name}"), F.lit(default))
    listed = lambda name: F.coalesce(F.concat(F.lit("['"), F.array_join(F.nullif(F.from_json(F.get_json_object(payload, f"$.{name}"), "array<string>"), F.array().cast("array<string>")), "', '"), F.lit("']")), F.lit("[]"))
    none = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    below = lambda what, c: F.format_string(f"{what} %.2f below threshold %.2f", F.bround(c, 2), F.bround(threshold, 2))
    said = {
        "job_failed": F.concat(F.lit("job "), none(job_id, "(unknown)"), F.lit(" failed")),
        "quality_below": below("quality score", body["quality_score"]),
        "confidence_collapse": below("mean confidence", body["confidence_mean"]),
        "record_count_drop": F.concat(F.lit("record count "), whole(body["records"]), F.lit(" below threshold "), at),
        "record_count_rise": F.concat(F.lit("record count "), whole(body["records"]), F.lit(" above threshold "), at),
        "circuit_breaker_trip": F.concat(F.lit("circuit breaker tripped: "), text("reason", "unspecified")),
        "self_healing_event": F.concat(F.lit("self-healing fired at rung "), text("rung", "?"), F.lit(" on "), none(domain, "page")),
        "schema_change": F.concat(F.lit("schema changed (added="), listed("added"), F.lit(", removed="), listed("removed"), F.lit(")")),
        "source_conflict_spike": F.concat(F.lit("source conflicts "), whole(F.coalesce(body["conflicts"], F.lit(0.0))), F.lit(" met/exceeded "), at),
        "budget_threshold": F.format_string("budget at %.0f%% (threshold %.0f%%)", F.bround(body["pct"] * 100, 0), F.bround(threshold * 100, 0)),
        "unexpected_removals": F.concat(whole(F.coalesce(body["removed"], F.lit(0.0))), F.lit(" unexpected removals (threshold "), at, F.lit(")")),
        "repeated_job_failure": F.concat(recent_failures.cast("string"), F.lit(" failures in window (threshold "), F.coalesce(at, F.lit("3")), F.lit(")")),
    }
    out = F.lit(None).cast("string")
    for name, words in said.items():
        out = F.when(condition == name, words).otherwise(out)
    return out


def run_alert_events(runs: DataFrame) -> DataFrame:
    """Run outcomes as events (seq, at, kind, client_id, task_id, job_id, domain, payload)."""
    payload = F.to_json(F.struct("quality_score", "confidence_mean", "records", "conflicts"))
    return runs.select("seq", "at", F.when(F.col("ok"), "job_completed").otherwise("job_failed").alias("kind"), "client_id", "task_id", "job_id", "domain", payload.alias("payload"))


def with_recent_failures(events: DataFrame, seconds: int = 600) -> DataFrame:
    """Adds recent_failures: failures of the same task in the last `seconds`, this one included; null for other events.

    Only failures of named tasks are sorted; all other events pass by. A task's time is cut in stretches of `seconds`; each
    failure is counted in its own and in the next one, so no task, however many failures it has, is one window.
    """
    failed = F.coalesce((F.col("kind") == "job_failed") & (F.col("task_id") != ""), F.lit(False))
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    own = F.floor(micros / span) if span else micros
    dealt = events.where(failed).withColumns({"_at": micros, "_own": own}).withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy("task_id", "_stretch").orderBy("_at").rangeBetween(-span, 0)
    counted = dealt.withColumn("recent_failures", F.count("*").over(w)).where("_stretch = _own").drop("_at", "_own", "_stretch")
    return counted.unionByName(events.where(~failed).withColumn("recent_failures", F.lit(None).cast("long")))


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(event, rule) pairs where the rule applies to the event and its condition holds, with scope_key, dedup_key and message.

    events carry recent_failures; rules (rule_id, scope, scope_id, condition_type, threshold, severity,
    cooldown_seconds, enabled). An event is entered once for everyone and once per client, task, job and domain that it
    names, and meets rules on kind, scope and scope id, an equality that Spark can hash or broadcast: a rule of one client
    meets that client's events alone.
    """
    kinds = F.create_map(*(F.lit(x) for k, v in CONDITIONS.items() for x in (k, v[0])))
    everyone = ~F.coalesce(F.col("scope").isin("task", "job", "domain") | ((F.col("scope") == "client") & (F.coalesce("scope_id", F.lit("")) != "")), F.lit(False))
    live = rules.where("enabled").withColumns({"_kind": kinds[F.col("condition_type")], "_scope": F.when(everyone, "").otherwise(F.col("scope")), "_id": F.when(everyone, "").otherwise(F.col("scope_id"))})
    columns = {"": F.lit(""), "client": F.col("client_id"), "task": F.col("task_id"), "job": F.col("job_id"), "domain": F.col("domain")}
    entered = events.where(F.col("kind").isin(*{v[0] for v in CONDITIONS.values()})).withColumn("_as", F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), c.alias("id")) for s, c in columns.items()))))
    pairs = entered.join(live, (F.col("kind") == F.col("_kind")) & (F.col("_as.scope") == F.col("_scope")) & (F.col("_as.id") == F.col("_id"))).drop("_as", "_kind", "_scope", "_id")
    body, holds = F.from_json("payload", _PAYLOAD), F.lit(False)
    for name, (_, value, op) in CONDITIONS.items():
        if value is None:
            test = F.lit(True)
        elif value == "recent_failures":
            test = F.col("recent_failures") >= F.coalesce("threshold", F.lit(3.0)).cast("int")
        else:
            v = F.coalesce(body[value], F.lit(0.0)) if value in ("conflicts", "removed") else body[value]
            test = {"<": v < F.col("threshold"), ">": v > F.col("threshold"), ">=": v >= F.col("threshold")}[op]
        holds = F.when(F.col("condition_type") == name, test).otherwise(holds)
    hit = pairs.where(F.coalesce(holds, F.lit(False)))
    key = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("task_id", "job_id", "domain")), F.lit("global"))
    digest = F.substring(F.sha2(F.concat_ws("|", "rule_id", "kind", "task_id", "job_id", "domain"), 256), 1, 16)
    said = message(F.col("condition_type"), F.col("payload"), F.col("job_id"), F.col("domain"), F.col("threshold"), F.col("recent_failures"))
    return hit.withColumns({"scope_key": key, "dedup_key": digest, "message": said})


def fires(at: np.ndarray, gap: np.ndarray, last: int | None) -> tuple[np.ndarray, int | None]:
    """Which of the matches at ascending microseconds fire, and when the last did: each at least its gap (microseconds) after the one before."""
    kept, k = np.zeros(len(at), bool), 0
    while k < len(at):
        if last is not None and gap[k] > 0 and at[k] - last < gap[k]:
            same = np.flatnonzero(gap[k:] != gap[k])
            end = k + int(same[0]) if len(same) else len(at)
            k += int(np.searchsorted(at[k:end], last + gap[k]))
            continue
        kept[k], last = True, int(at[k])
        k += 1
    return kept, last


def _cool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (rule_id, scope_key) and time; a key may go on in the next frame, so its last firing is kept."""
    key, last = None, None
    for frame in frames:
        at, gap = frame["at"].to_numpy("datetime64[us]").astype(np.int64), frame["cooldown_seconds"].to_numpy(np.int64) * 1_000_000
        keys = list(zip(frame["rule_id"], frame["scope_key"], strict=True))
        edges = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
        kept = np.zeros(len(keys), bool)
        for a, b in zip(edges, edges[1:], strict=False):
            last = last if keys[a] == key else None
            kept[a:b], last = fires(at[a:b], gap[a:b], last)
            key = keys[a]
        yield frame[kept]


def alert_cooldown(matches: DataFrame) -> DataFrame:
    """Matches that fire: per (rule, scope key), those at least the cooldown after the last that fired.

    A fold over time. Rows are dealt by key and sorted within tasks by Spark, which spills; the fold keeps one time per key,
    whatever the number of its matches.
    """
    ordered = matches.repartition("rule_id", "scope_key").sortWithinPartitions("rule_id", "scope_key", "at", "seq")
    return ordered.mapInPandas(_cool, matches.schema)


def route_alerts(fired: DataFrame, connectors: DataFrame) -> DataFrame:
    """One row per fired alert and delivery: connector_id, or an error where a target resolves to nothing.

    fired has targets (array). A target is a connector's id, else a type, else a client; without targets all
    notification connectors of the alert's client get it. Connectors below an alert's severity are left out.
    """
    conn = connectors.select(F.col("connector_id").alias("cid"), F.col("type").alias("ctype"), F.col("client_id").alias("cclient"), F.col("min_severity").alias("least"), F.col("notifies"))
    rank = lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c))
    base = fired.select("alert_id", "client_id", "severity", F.explode_outer("targets").alias("target"))
    named, bare = base.where("target is not null"), base.where("target is null")
    own = F.col("cclient") == F.col("client_id")
    by_id = named.join(conn, own & (F.col("cid") == F.col("target"))).withColumn("how", F.lit(0))
    by_type = named.join(conn, own & (F.col("ctype") == F.col("target"))).withColumn("how", F.lit(1))
    by_client = named.join(conn, F.col("cclient") == F.col("target")).withColumn("how", F.lit(2))
    found = by_id.unionByName(by_type).unionByName(by_client)
    best = F.min("how").over(Window.partitionBy("alert_id", "target"))
    found = found.withColumn("best", best).where("how = best").drop("best", "how").unionByName(bare.join(conn.where("notifies"), own))
    sent = found.where(rank("severity") >= rank("least")).select("alert_id", F.coalesce("target", F.lit("")).alias("target"), F.col("cid").alias("connector_id"), F.lit(None).cast("string").alias("error"))
    lost = named.join(found.select("alert_id", "target").distinct(), ["alert_id", "target"], "left_anti").select("alert_id", "target", F.lit(None).cast("string").alias("connector_id"), F.lit("unresolved target").alias("error"))
    return sent.unionByName(lost)


def incidents(fired: DataFrame, endings: DataFrame) -> DataFrame:
    """Incidents (client_id, dedup_key, number, occurrences, severity, jobs, domains, started_at, ended_at).

    Alerts of one client and key touch the same incident until it ends; the next alert opens a new one: gaps and
    islands over the endings (client_id, dedup_key, at) of each key.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    both = fired.select("client_id", "dedup_key", "at", "seq", rank.alias("rank"), "job_id", "domain", F.lit(0).alias("ends")).unionByName(
        endings.select("client_id", "dedup_key", "at", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("rank"), F.lit("").alias("job_id"), F.lit("").alias("domain"), F.lit(1).alias("ends")))
    w = Window.partitionBy("client_id", "dedup_key").orderBy("at", "ends", "seq").rowsBetween(Window.unboundedPreceding, -1)
    islands = both.withColumn("island", F.coalesce(F.sum("ends").over(w), F.lit(0)))
    names = lambda c: F.array_sort(F.collect_set(F.when((F.col("ends") == 0) & (F.col(c) != ""), F.col(c))))
    grouped = islands.groupBy("client_id", "dedup_key", "island").agg(
        F.count_if(F.col("ends") == 0).alias("occurrences"), F.max("rank").alias("rank"), names("job_id").alias("jobs"), names("domain").alias("domains"),
        F.min(F.when(F.col("ends") == 0, F.col("at"))).alias("started_at"), F.max(F.when(F.col("ends") == 1, F.col("at"))).alias("ended_at"))
    number = F.row_number().over(Window.partitionBy("client_id", "dedup_key").orderBy("island"))
    return grouped.where("occurrences > 0").withColumn("number", number).withColumn("severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank"))).drop("island", "rank")


def resolve_incidents(incidents_: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Open incidents with a job that succeeded become resolved."""
    jobs = incidents_.where(~F.col("status").isin(*ENDED)).select("incident_id", F.explode("jobs").alias("job_id"))
    done = jobs.join(succeeded.select("job_id"), "job_id", "left_semi").select("incident_id").distinct().withColumn("_done", F.lit(True))
    return incidents_.join(done, "incident_id", "left").withColumn("status", F.when(F.col("_done"), "resolved").otherwise(F.col("status"))).drop("_done")


def incident_report(incidents_: DataFrame, now: Column, recent: int = 100) -> DataFrame:
    """Per client the newest incidents with their duration and failure class."""
    seconds = F.unix_seconds(F.coalesce(F.col("ended_at"), now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in FAILURE_CLASSES.items() for x in kv))[F.col("condition_type")], F.lit("unknown"))
    place = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("started_at"), "incident_id"))
    return incidents_.withColumns({"place": place, "duration_seconds": seconds, "failure_class": kind, "open": F.col("ended_at").isNull()}).where(F.col("place") <= recent)


def slo_status(slos: DataFrame, samples: DataFrame, now: Column, margin: float = 0.1) -> DataFrame:
    """(slo_id, n, mean, status, margin): samples of the rolling window against the target.

    slos (slo_id, direction above/below, target, window_days, min_samples, enabled). Samples older than the longest window
    go where they are read; the others meet their objective's window, and means are taken before the rest of it is joined.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("sampled_at").cast("timestamp"))
    longest = slos.agg((F.max("window_days") * 86_400_000_000).alias("_longest"))
    recent = samples.select("slo_id", "value", age.alias("_age")).crossJoin(F.broadcast(longest)).where("_age >= 0 and _age <= _longest")  # one row
    inside = recent.join(slos.select("slo_id", "window_days"), "slo_id").where(F.col("_age") <= F.col("window_days") * 86_400_000_000)
    means = slos.join(inside.groupBy("slo_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "slo_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gap = F.when(F.col("direction") == "above", F.col("mean") - F.col("target")).otherwise(F.col("target") - F.col("mean"))
    status = F.when(~F.col("enabled"), "DISABLED").when(F.col("n") < F.col("min_samples"), "INSUFFICIENT").when(F.col("gap") < 0, "BREACHED").when(F.col("gap") < F.abs(F.col("target")) * margin, "AT_RISK").otherwise("MEETING")
    return means.withColumn("gap", gap).withColumn("status", status).select("slo_id", "n", "mean", "status", F.col("gap").alias("margin"))
