"""Consensus over sources, confidence, and what sources earn by agreeing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import blank_to_null, comparison_value
from assayer.functions.urls import canonical
from assayer.sources.shared import new_folder

# Signal weights, trust limits.
WEIGHTS = {"consensus": 0.3, "source_count": 0.15, "mean_trust": 0.15, "freshness": 0.1, "selector": 0.1, "validation": 0.1, "historical_stability": 0.05}
ANOMALY_WEIGHT = 0.05
KEY, UNITS = ["record_id", "field_name"], 1_000_000_000
LEAST_TRUST, MOST_TRUST, NEUTRAL, DECAY_DAYS = 0.05, 0.99, 0.5, 90


def field_kind(name: Column) -> Column:
    name = F.lower(name)
    return F.when(name.rlike("price|cost"), "currency").when(name.contains("date"), "date").when(name.rlike("url|link"), "url").when(name.contains("email"), "email").otherwise("text")


def _votes(observations: DataFrame) -> DataFrame:
    """(seq, record_id, field_name, value, source, g, w) of the observations that have a value."""
    trust = F.greatest(F.coalesce(F.col("trust_score"), F.lit(0.0)), F.lit(0.0))
    return observations.where(F.col("value").rlike(r"\S")).select(
        "seq", "record_id", "field_name", "value", F.coalesce(blank_to_null(F.col("source_domain")), F.lit("unknown")).alias("source"),
        F.coalesce(blank_to_null(F.col("independence_group")), blank_to_null(F.col("source_domain")), F.lit("unknown")).alias("g"), F.round(trust * UNITS).cast("long").alias("w"))


def _forms(raw: DataFrame, kinds: Mapping[str, str] | None) -> DataFrame:
    """(field, told, norm): the form for comparison of every distinct (field_name, value), worked out once each.

    URLs, whose canonical form is long work, are apart, so that the plan for all other values stays small.
    """
    kind = field_kind(F.col("field"))
    for name, k in (kinds or {}).items():
        kind = F.when(F.col("field") == name, k).otherwise(kind)
    told = raw.select(F.col("field_name").alias("field"), F.col("value").alias("told")).distinct().withColumn("kind", kind)
    urls = told.where("kind = 'url'").select("field", "told", comparison_value(F.col("told"), F.lit("url"), canonical(F.trim("told"))).alias("norm"))
    return told.where("kind is distinct from 'url'").select("field", "told", comparison_value(F.col("told"), F.col("kind")).alias("norm")).unionAll(urls)


def _in_form(rows: DataFrame, forms: DataFrame) -> DataFrame:
    return rows.join(forms, rows["field_name"].eqNullSafe(forms["field"]) & (rows["value"] == forms["told"])).drop("field", "told")


def _values(votes: DataFrame, kinds: Mapping[str, str] | None) -> DataFrame:
    """Weights and counts per value, of each group its heaviest: numbers and one text per row.

    Votes are summed per (record, field, group, value) before they are shuffled, so a field of which millions of votes tell
    is millions of rows in no task; only distinct values are brought into form. Weights are whole billionths: sums do not
    depend on the order of rows.
    """
    raw = votes.groupBy(*KEY, "g", "value").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("seq").alias("seq"))
    summed = _in_form(raw, _forms(raw, kinds)).groupBy(*KEY, "g", "norm").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.min(F.struct("seq", "value")).alias("first"))
    best = F.max(F.struct("w", (-F.col("first.seq")).alias("early"), "norm", "n", F.col("first.value").alias("raw"))).alias("v")
    groups = summed.groupBy(*KEY, "g").agg(best, F.min("first.seq").alias("g_seq")).select(*KEY, "g", "g_seq", "v.w", "v.norm", "v.n", "v.raw")
    return groups.groupBy(*KEY, "norm").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("clusters"), F.min(F.struct("g_seq", "raw")).alias("first"))


def consensus(observations: DataFrame, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """One row per (record_id, field_name): winner, confidence, and numbers of sources, clusters and conflicts.

    From (seq, record_id, field_name, source_domain, value, trust_score, independence_group); seq settles ties.
    Values are compared in a coarse form (numbers to four places, days, canonical URLs, lower case). An independence group (else its domain) has one vote, its heaviest
    value; the value with the most weight wins, then the one with fewer sources, then the first seen. Without any
    trust, source counts are the weights. confidence: share of weight times min(1, 0.4 + 0.2 (groups - 1)).
    """
    return _winners(_values(_votes(observations), kinds), KEY)


def _winners(values: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """more: further aggregates over the values of a (record, field), kept under their names."""
    entry = F.struct("norm", "w", "n", F.col("first.raw").alias("raw"))
    seen = (-F.col("first.g_seq")).alias("early")
    fields = values.groupBy(*keys).agg(
        F.sum("w").alias("sum_w"), F.sum("clusters").alias("total_clusters"), (F.count("*") - 1).alias("n_conflicts"),
        F.max(F.struct("w", (-F.col("n")).alias("few"), seen, entry.alias("v"))).alias("heaviest"), F.max(F.struct("n", seen, entry.alias("v"))).alias("commonest"), *(c.alias(name) for name, c in more.items()))
    trusted = F.col("sum_w") > 0
    fields = fields.withColumn("win", F.when(trusted, F.col("heaviest.v")).otherwise(F.col("commonest.v")))
    ratio = F.when(trusted, F.col("win.w") / F.col("sum_w")).otherwise(F.col("win.n") / F.col("total_clusters"))
    note = F.when(F.col("total_clusters") == 1, "only one independent source").when(F.col("n_conflicts") > 0, F.concat(F.col("n_conflicts").cast("string"), F.lit(" dissenting values"))).otherwise("")
    return fields.select(
        *keys, F.col("win.raw").alias("consensus_value"), F.col("win.norm").alias("normalized_value"), (ratio * F.least(F.lit(1.0), 0.4 + 0.2 * (F.col("total_clusters") - 1))).alias("confidence"),
        F.col("win.n").alias("n_sources"), "total_clusters", "n_conflicts", note.alias("note"), trusted.alias("trusted"), *more)


def triangulate(observations: DataFrame, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """consensus with the lists behind the numbers: winning_sources, and conflicts (value, normalized, sources, weight) in the order seen.

    The lists of a (record, field) are one row; where its sources are too many for that, consensus has the numbers. Since
    its votes come together for them anyway, they are shuffled once, by (record, field), and every later step is within a
    partition: the lists go along with the sums instead of being joined to them. Rows without a record or field are left out.
    """
    votes = _votes(observations).where(F.col("record_id").isNotNull() & F.col("field_name").isNotNull())
    forms = _forms(votes, kinds)
    path = f"{new_folder(forms.sparkSession)}/forms"
    forms.write.parquet(path)  # as a table its size is known before the votes are joined to it, so they need not move for a small one
    told = _in_form(votes, forms.sparkSession.read.schema(forms.schema).parquet(path))
    told = told.withColumn("key", F.struct(*KEY)).repartition("key")  # one column, since Spark folds a constant field name out of two
    summed = told.groupBy("key", "g", "norm").agg(
        F.sum("w").alias("w"), F.count("*").alias("n"), F.min(F.struct("seq", "value")).alias("first"), F.collect_list(F.struct("seq", "source")).alias("sources"))
    best = F.max(F.struct("w", (-F.col("first.seq")).alias("early"), "norm", "n", F.col("first.value").alias("raw"), "sources")).alias("v")
    groups = summed.groupBy("key", "g").agg(best, F.min("first.seq").alias("g_seq"))
    placed = F.transform("v.sources", lambda s: F.struct(F.col("g_seq"), s["seq"].alias("seq"), s["source"].alias("source")))
    groups = groups.select("key", "g_seq", "v.w", "v.norm", "v.n", "v.raw", placed.alias("sources"))
    values = groups.groupBy("key", "norm").agg(
        F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("clusters"), F.min(F.struct("g_seq", "raw")).alias("first"), F.array_sort(F.flatten(F.collect_list("sources"))).alias("s"))
    one = F.struct(F.col("first.g_seq").alias("seen"), F.col("first.raw").alias("value"), F.col("norm").alias("normalized"), F.col("s.source").alias("sources"), "w", "n")
    found = _winners(values, ["key"], lists=F.collect_list(one))
    won = lambda v: v["normalized"] == F.col("normalized_value")
    weight = lambda v: F.when(F.col("trusted"), v["w"] / UNITS).otherwise(v["n"].cast("double"))
    others = F.array_sort(F.filter("lists", lambda v: ~won(v)))
    conflicts = F.transform(others, lambda v: F.struct(v["value"].alias("value"), v["normalized"].alias("normalized"), v["sources"].alias("sources"), weight(v).alias("weight")))
    winning = F.filter("lists", won)[0]["sources"]
    return found.select("key.*", "consensus_value", "normalized_value", "confidence", winning.alias("winning_sources"), "total_clusters", conflicts.alias("conflicts"), "note")


def consensus_to_records(consensus: DataFrame, base: DataFrame, fields: list[str]) -> DataFrame:
    """The consensus values over each record's first base row (by seq)."""
    wide = consensus.groupBy("record_id").pivot("field_name", fields).agg(F.first("consensus_value"))
    first = base.groupBy("record_id").agg(F.min_by(F.struct(*(c for c in base.columns if c != "record_id")), "seq").alias("r")).select("record_id", "r.*")
    names = [F.coalesce(wide[f].cast(first.schema[f].dataType), first[f]).alias(f) if f in first.columns else wide[f] for f in fields]
    rest = [first[c] for c in first.columns if c not in ("record_id", *fields)]
    return first.join(wide, "record_id", "left").select("record_id", *names, *rest)


def price_agreement(items: DataFrame) -> DataFrame:
    """Each product's sources against their mean price: 1 less the relative distance, and `k/n sources` within 10 %."""
    means = items.groupBy("product").agg(F.avg("price").alias("mean_price"), F.count("price").alias("n"))
    scored = items.join(means, "product")
    score = F.when(F.col("mean_price") > 0, F.greatest(F.lit(0.0), 1 - F.abs(F.col("price") - F.col("mean_price")) / F.col("mean_price")))
    return scored.withColumn("agreement", score)


def score_confidence(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Adds confidence, tier and reasons: the weighted mean of the signals that are there, less the anomaly penalty."""
    w = {**WEIGHTS, **(weights or {})}
    unit = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)))
    count = F.when(F.col("source_count") == 1, 0.2).when(F.col("source_count") == 2, 0.6).when(F.col("source_count") > 2, 1.0)
    signals = {"source_count": count, "validation": F.col("validation_passed").cast("double"), **{c: unit(c) for c in ("consensus", "mean_trust", "freshness", "selector", "historical_stability")}}
    total = sum((F.when(s.isNotNull(), w[k]).otherwise(0.0) for k, s in signals.items()), F.lit(0.0))
    raw = sum((F.coalesce(s * w[k], F.lit(0.0)) for k, s in signals.items()), F.lit(0.0)) / F.when(total > 0, total)
    penalty = F.coalesce(unit("anomaly_score") * ANOMALY_WEIGHT, F.lit(0.0))
    value = F.when(raw.isNull(), 0.0).otherwise(F.least(F.greatest(raw - penalty, F.lit(0.0)), F.lit(1.0)))
    tier = F.when(F.col("confidence") >= 0.85, "High").when(F.col("confidence") >= 0.6, "Moderate").when(F.col("confidence") >= 0.35, "Low").otherwise("Very low")
    reasons = F.array_compact(F.array(
        F.when(F.col("consensus") >= 0.8, "sources agree").when(F.col("consensus") < 0.5, "sources disagree"), F.when(F.col("source_count") == 1, "one source only"),
        F.when(F.col("mean_trust") >= 0.75, "trusted sources").when(F.col("mean_trust") < 0.4, "little trusted sources"), F.when(F.col("freshness") >= 0.9, "fresh").when(F.col("freshness") < 0.4, "stale"),
        F.when(~F.col("validation_passed"), "failed validation"), F.when(F.col("historical_stability") >= 0.9, "stable over runs"), F.when(F.col("anomaly_score") > 0.5, "anomaly")))
    return df.withColumn("confidence", value).withColumn("tier", tier).withColumn("reasons", F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("mixed signals"))


def record_confidence(scores: DataFrame, mode: str = "min") -> DataFrame:
    """(record_id, confidence): the least, or the mean, of a record's field scores."""
    return scores.groupBy("record_id").agg((F.avg if mode == "mean" else F.min)("confidence").alias("confidence"))


def _trust(n: Column, agree: Column, disagree: Column, stale: Column, violations: Column, authority: Column) -> Column:
    base = F.lit(NEUTRAL) + 0.4 * ((agree + 1.0) / (agree + disagree + 2.0) - 0.5) - 0.3 * stale / n - 0.4 * violations / n
    return F.greatest(F.lit(LEAST_TRUST), F.least(F.lit(MOST_TRUST), F.when(n > 0, base).otherwise(NEUTRAL) + F.when(authority, 0.2).otherwise(0.0)))


def source_trust(events: DataFrame) -> DataFrame:
    """Counters and trust per domain from (domain, kind, seen_at, manual_authority); kinds agree, disagree, stale, violation."""
    kinds = {"agreement_count": "agree", "disagreement_count": "disagree", "staleness_flags": "stale", "schema_violations": "violation"}
    counts = events.groupBy(F.lower("domain").alias("domain")).agg(
        F.count("*").alias("observation_count"), *(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()),
        F.bool_or("manual_authority").alias("manual_authority"), F.max("seen_at").alias("last_updated"))
    return counts.withColumn("trust_score", _trust(F.col("observation_count"), *(F.col(n) for n in kinds), F.col("manual_authority")))


def trust_decay(table: DataFrame, now: Column) -> DataFrame:
    """Sources not seen for 90 days start anew."""
    old = F.coalesce(F.unix_seconds(now) - F.unix_seconds(F.col("last_updated").cast("timestamp")) >= DECAY_DAYS * 86400, F.lit(False))
    reset = {"trust_score": F.lit(NEUTRAL), "last_updated": now} | {c: F.lit(0).cast("long") for c in ("observation_count", "agreement_count", "disagreement_count", "staleness_flags", "schema_violations")}
    return table.select(*(F.when(old, reset[c]).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c in table.columns))


def trust_updates(consensus: DataFrame) -> DataFrame:
    """(domain, agreed, disagreed) over all consensus rows: a winner agrees, a dissenter that is no winner disagrees."""
    winners = F.array_distinct("winning_sources")
    losers = F.array_except(F.flatten("conflicts.sources"), winners)
    both = F.concat(F.transform(winners, lambda d: F.struct(d.alias("domain"), F.lit(1).alias("yes"))), F.transform(losers, lambda d: F.struct(d.alias("domain"), F.lit(0).alias("yes"))))
    return consensus.select(F.inline(both)).groupBy("domain").agg(F.sum("yes").alias("agreed"), F.sum(1 - F.col("yes")).alias("disagreed"))


def historical_stability(versions: DataFrame, current: DataFrame) -> DataFrame:
    """(record_id, field_name, historical_stability): share of earlier versions with the current value."""
    now = current.select("record_id", "field_name", F.col("value").alias("now"))
    same = F.col("value").eqNullSafe(F.col("now")).cast("double")
    return versions.join(now, ["record_id", "field_name"]).groupBy("record_id", "field_name").agg(F.avg(same).alias("historical_stability"))


def domain_outcomes(runs: DataFrame) -> DataFrame:
    """(domain, attempts, successful_runs, total_records, score) from (run_id, url, records)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    per_run = runs.withColumn("domain", host).where("domain <> ''").groupBy("run_id", "domain").agg(F.sum("records").alias("records"))
    stats = per_run.groupBy("domain").agg(F.count("*").alias("attempts"), F.count_if(F.col("records") > 0).alias("successful_runs"), F.sum("records").alias("total_records"))
    mean = F.col("total_records") / F.greatest(F.lit(1), F.col("successful_runs"))
    bonus = F.when(F.col("successful_runs") > 0, F.least(F.lit(0.15), F.log1p(mean) / F.log1p(F.lit(20.0)) * 0.15)).otherwise(-0.2)
    return stats.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("successful_runs") + 1.0) / (F.col("attempts") + 2.0) + bonus)))


def apply_reputation(urls: DataFrame, stats: DataFrame, weight: float = 8.0) -> DataFrame:
    """urls (url, base_score) with adjusted score, best first; an unknown domain is neutral."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    joined = urls.withColumn("domain", host).join(stats.select("domain", F.col("score").alias("reputation")), "domain", "left")
    return joined.withColumn("adjusted", F.col("base_score") + (F.coalesce("reputation", F.lit(NEUTRAL)) - 0.5) * weight).orderBy(F.desc("adjusted"), "url")
