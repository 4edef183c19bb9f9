"""Quality rules, anomalies against history, and the gate before publication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import EMAIL
from assayer.operators.cleaning import BOOKKEEPING, identity

# What texts of a declared type look like.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
CURRENCY = r"^\s*[^0-9\-+]{0,3}\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\s*[A-Za-z]{0,4}\s*$"


@dataclass(frozen=True)
class QualityRules:
    min_records: int = 1
    max_failed_page_pct: float = 0.3
    max_empty_page_pct: float = 0.5
    min_populated_field_pct: float = 0.5
    max_duplicate_rate: float = 0.2
    max_source_disagreement_rate: float = 0.25
    freshness_window_seconds: int = 0
    freshness_fields: Sequence[str] = ()
    min_freshness_rate: float = 1.0
    source_disagreement_rate: float | None = None
    required_fields: Sequence[str] = ()
    field_types: Mapping[str, str] = field(default_factory=dict)
    numeric_bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    failed_page_count: int = 0
    empty_page_count: int = 0
    total_page_count: int = 0


def is_missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def matches_type(c: Column, kind: str) -> Column:
    """Whether a text looks like a kind; empty text and unknown kinds pass."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    day = F.when(c.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd").isNotNull()).otherwise(False)
    checks = {"number": c.rlike(NUMBER), "currency": c.rlike(CURRENCY), "url": c.rlike(r"(?i)^\s*https?://\S+\s*$"), "email": F.trim(c).rlike(EMAIL), "phone": digits.between(9, 15), "date": day}
    return F.coalesce(checks.get(kind, F.lit(True)), F.lit(True)) | (F.coalesce(c, F.lit("")) == "")


def check_types(df: DataFrame, types: Mapping[str, str], key: str, samples: int = 3) -> DataFrame:
    """(field, kind, violations, first_key, last_key, samples): cells that do not look like their declared type.

    samples: (key, value) of the bad cells with the smallest keys, at most that many; Spark cuts them in each task before
    they are shuffled.
    """
    cells = df.select(F.col(key).alias("_key"), F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"), (~matches_type(F.col(c).cast("string"), k)).alias("bad")) for c, k in types.items()))))
    bad = F.when(F.col("bad"), F.col("_key"))
    counts = cells.groupBy("field", "kind").agg(F.count_if("bad").alias("violations"), F.min(bad).alias("first_key"), F.max(bad).alias("last_key"))
    place = F.row_number().over(Window.partitionBy("field").orderBy("_key", "value"))
    shown = cells.where("bad").withColumn("_n", place).where(F.col("_n") <= samples).groupBy("field").agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(F.col("_key").alias("key"), "value").alias("s")))).alias("l"))
    sampled = shown.select(F.col("field").alias("_field"), F.col("l.s").alias("samples"))
    return counts.join(sampled, F.col("field") == F.col("_field"), "left").drop("_field").withColumn("samples", F.coalesce("samples", F.array().cast(dict(sampled.dtypes)["samples"])))


def freshness(df: DataFrame, fields: Sequence[str], window_seconds: int, now: Column) -> DataFrame:
    """One row: total, fresh, missing and unparseable rows by the first field that holds something."""
    raw = F.coalesce(*(F.when(~is_missing(c), F.col(c).cast("string")) for c in fields))
    at = F.try_to_timestamp(F.replace(raw, F.lit("Z"), F.lit("")))
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at)
    return df.agg(F.count("*").alias("total"), F.count_if(age <= window_seconds).alias("fresh"), F.count_if(raw.isNull()).alias("missing"), F.count_if(raw.isNotNull() & at.isNull()).alias("unparseable"))


def quality_report(df: DataFrame, rules: QualityRules, now: Column | None = None) -> DataFrame:
    """(rule, passed, value) for ten rules, from one pass over df and one count of its identities."""
    fields = [c for c in df.columns if c not in BOOKKEEPING]
    n = F.count("*")
    required = sum((F.count_if(is_missing(c)) for c in rules.required_fields), F.lit(0))
    types = sum((F.count_if(~matches_type(F.col(c).cast("string"), k)) for c, k in rules.field_types.items() if c in df.columns), F.lit(0))
    bounds = sum((F.count_if(F.col(c).cast("string").try_cast("double").isNotNull() & ~F.col(c).cast("string").try_cast("double").between(lo, hi)) for c, (lo, hi) in rules.numeric_bounds.items()), F.lit(0))
    populated = sum((F.count_if(~is_missing(c)) for c in fields), F.lit(0)) / (n * len(fields))
    one = df.agg(n.alias("n"), populated.alias("populated"), required.alias("required"), types.alias("types"), bounds.alias("bounds"))
    doubles = df.select(identity(df).alias("k")).where("k is not null").groupBy("k").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra"))
    whole = one.crossJoin(doubles)  # one row each
    if rules.freshness_fields and rules.freshness_window_seconds > 0 and now is not None:
        whole = whole.crossJoin(freshness(df, rules.freshness_fields, rules.freshness_window_seconds, now))  # one row
        fresh = (F.when(F.col("n") > 0, F.col("fresh") / F.col("n") >= rules.min_freshness_rate).otherwise(False) & (F.col("missing") == 0) & (F.col("unparseable") == 0), F.when(F.col("n") > 0, F.col("fresh") / F.col("n")).otherwise(0.0))
    else:
        fresh = (F.lit(True), F.lit(None).cast("double"))
    share = lambda k: k / rules.total_page_count if rules.total_page_count > 0 else None
    failed, empty, odd = share(rules.failed_page_count), share(rules.empty_page_count), rules.source_disagreement_rate
    rate = F.when(F.col("n") > 0, F.col("extra") / F.col("n")).otherwise(0.0)
    results = [
        ("min_records", F.col("n") >= rules.min_records, F.col("n")),
        ("max_failed_page_pct", F.lit(failed is None or failed <= rules.max_failed_page_pct), F.lit(failed)),
        ("max_empty_page_pct", F.lit(empty is None or empty <= rules.max_empty_page_pct), F.lit(empty)),
        ("min_populated_field_pct", F.coalesce(F.col("populated") >= rules.min_populated_field_pct, F.lit(False)), F.coalesce("populated", F.lit(0.0))),
        ("required_fields", F.col("required") == 0, F.col("required")), ("type_validity", F.col("types") == 0, F.col("types")), ("range_validity", F.col("bounds") == 0, F.col("bounds")),
        ("duplicate_rate", rate <= rules.max_duplicate_rate, rate),
        ("source_disagreement", F.lit(odd is None or odd <= rules.max_source_disagreement_rate), F.lit(odd)), ("freshness", *fresh)]
    return whole.select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), p.alias("passed"), v.cast("double").alias("value")) for r, p, v in results))))


def quality_verdict(report: DataFrame) -> DataFrame:
    """One row: passed, score, failed_rules, action (publish, retry, escalate or quarantine)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule"))))
    one = report.agg(F.bool_and("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("score"), failed.alias("failed_rules"))
    pages = F.arrays_overlap("failed_rules", F.array(F.lit("max_failed_page_pct"), F.lit("max_empty_page_pct")))
    return one.withColumn("action", F.when(F.col("passed"), "publish").when(pages, "retry").when(F.col("score") < 0.5, "escalate").otherwise("quarantine"))


def anomalies(current: DataFrame, history: DataFrame, numeric: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(kind, field, severity, measure) of all findings: mean shift, sudden zero, sudden identical, distribution shift.

    The first is one aggregate per side. The others start from the same counts per (field, value) of both sides, whose
    shuffle Spark runs once.
    """
    counts = _value_counts(current, history, fields)
    return zscore(current, history, numeric).unionByName(_sudden_zero(counts, 0.8)).unionByName(_sudden_identical(counts, 3)).unionByName(_distribution_shift(counts, 0.4))


def _value_counts(current: DataFrame, history: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, c, h): rows of both sides per value, null for missing."""
    cells = lambda df, side: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.when(~is_missing(c), F.col(c).cast("string")).alias("value")) for c in fields))), F.lit(side).alias("side"))
    return cells(current, 1).unionAll(cells(history, 0)).groupBy("field", "value").agg(F.sum("side").alias("c"), F.sum(1 - F.col("side")).alias("h"))


def _profile(counts: DataFrame) -> DataFrame:
    """Per field: rows, rows with a value, and distinct values of both sides."""
    some = F.col("value").isNotNull()
    return counts.groupBy("field").agg(*(
        agg.alias(f"{side}_{name}") for side in ("c", "h") for name, agg in (
            ("n", F.sum(side)), ("some", F.coalesce(F.sum(F.when(some, F.col(side))), F.lit(0))), ("distinct", F.count_if(some & (F.col(side) > 0))))))


def _finding(df: DataFrame, kind: str, severity: Column, measure: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "field", severity.alias("severity"), measure.cast("double").alias("measure"))


def zscore(current: DataFrame, history: DataFrame, numeric: Sequence[str], least: float = 3.0, min_history: int = 5) -> DataFrame:
    number = lambda c: F.when(~is_missing(c) & ~F.isnan(F.col(c).cast("string").try_cast("double")), F.col(c).cast("string").try_cast("double"))
    now = current.agg(*(F.avg(number(c)).alias(f"now_{k}") for k, c in enumerate(numeric)))
    old = history.agg(*(a.alias(f"{n}_{k}") for k, c in enumerate(numeric) for n, a in (("n", F.count(number(c))), ("mean", F.avg(number(c))), ("sigma", F.stddev_pop(number(c))))))
    both = now.crossJoin(old)  # one row each
    rows = both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), *(F.col(f"{n}_{k}").alias(n) for n in ("now", "n", "mean", "sigma"))) for k, c in enumerate(numeric)))))
    z = F.when(F.col("sigma") > 0, (F.col("now") - F.col("mean")) / F.col("sigma"))
    found = rows.withColumn("z", z).where((F.col("n") >= min_history) & (F.abs("z") >= least))
    return _finding(found, "zscore", F.when(F.abs("z") >= 5, "critical").otherwise("warning"), F.col("z"))


def _sudden_zero(counts: DataFrame, populated: float) -> DataFrame:
    share = F.col("h_some") / F.col("h_n")
    both = _profile(counts).where("c_n > 0 and h_n > 0")
    return _finding(both.where((share >= populated) & (F.col("c_some") == 0)), "sudden_zero", F.lit("critical"), share)


def sudden_zero(current: DataFrame, history: DataFrame, fields: Sequence[str], populated: float = 0.8) -> DataFrame:
    return _sudden_zero(_value_counts(current, history, fields), populated)


def _sudden_identical(counts: DataFrame, min_distinct: int) -> DataFrame:
    return _finding(_profile(counts).where((F.col("c_some") >= 3) & (F.col("h_distinct") >= min_distinct) & (F.col("c_distinct") == 1)), "sudden_identical", F.lit("critical"), F.col("h_distinct"))


def sudden_identical(current: DataFrame, history: DataFrame, fields: Sequence[str], min_distinct: int = 3) -> DataFrame:
    return _sudden_identical(_value_counts(current, history, fields), min_distinct)


def _distribution_shift(counts: DataFrame, most: float) -> DataFrame:
    totals = _profile(counts).select("field", F.col("c_some").alias("cn"), F.col("h_some").alias("hn")).where("cn > 0 and hn > 0")
    l1 = counts.where("value is not null").join(totals, "field").groupBy("field").agg(F.sum(F.abs(F.col("c") / F.col("cn") - F.col("h") / F.col("hn"))).alias("l1"))
    return _finding(l1.where(F.col("l1") >= most), "distribution_shift", F.lit("warning"), F.col("l1"))


def distribution_shift(current: DataFrame, history: DataFrame, fields: Sequence[str], most: float = 0.4) -> DataFrame:
    return _distribution_shift(_value_counts(current, history, fields), most)


def publication_gate(verdict: DataFrame, findings: DataFrame, by: str | None = None, block_on_critical: bool = True) -> DataFrame:
    """(state, reason, score, anomalies): QUALITY_FAILED, then QUARANTINED on a critical anomaly unless block_on_critical is off, else READY.

    One row, or with `by` one per dataset of verdict; a dataset without findings has none.
    """
    counts = (F.count("*").alias("anomalies"), F.count_if(F.col("severity") == "critical").alias("critical"))
    if by is None:
        both = verdict.crossJoin(findings.agg(*counts))  # one row each
    else:
        both = verdict.join(findings.groupBy(by).agg(*counts), by, "left").fillna(0, ["anomalies", "critical"])
    held = F.lit(block_on_critical) & (F.col("critical") > 0)
    state = F.when(~F.col("passed"), "QUALITY_FAILED").when(held, "QUARANTINED").otherwise("READY")
    reason = F.when(~F.col("passed"), F.array_join("failed_rules", ", ")).when(held, F.concat(F.col("critical").cast("string"), F.lit(" critical anomalies"))).otherwise("passed")
    return both.select(*([by] if by else []), state.alias("state"), reason.alias("reason"), "score", "anomalies")


def override_gate(decision: DataFrame, justification: str) -> DataFrame:
    """READY by hand; it takes a justification."""
    if not justification.strip():
        raise ValueError("an override needs a justification")
    return decision.withColumn("state", F.lit("READY")).withColumn("reason", F.lit(f"override: {justification.strip()}"))


def duplicate_burst(df: DataFrame, key: Column, least: int = 5, share: float = 0.5) -> DataFrame:
    """(key, n, burst) of the keys that repeat `least` times or hold `share` of all rows."""
    counts = df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("key is not null")
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(total).where((F.col("n") >= least) | (F.col("n") >= share * F.col("total"))).select("key", "n", (F.col("n") / F.col("total")).alias("share"))  # total: one row


def identical_fields(df: DataFrame, batch: str, fields: Sequence[str], least: int = 5) -> DataFrame:
    """(batch, field, value): columns whose values in a batch are all equal, among at least `least`."""
    cells = df.select(F.col(batch).alias("batch"), F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.when(~is_missing(c), F.col(c).cast("string")).alias("value")) for c in fields))))
    groups = cells.groupBy("batch", "field").agg(F.count("value").alias("n"), F.min("value").alias("value"), F.max("value").alias("top"))
    return groups.where((F.col("n") >= least) & (F.col("value") == F.col("top"))).select("batch", "field", "value")
