"""Cleaning record tables, and guards on their cells. Nothing here shuffles: every operator is one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as T

# Identity columns in order of preference, columns that are bookkeeping.
IDENTITY = ("title", "business_name", "job_title", "name", "url", "source_url")
BOOKKEEPING = ("source_url", "diff_status", "_numeric_price")
# Fixed patterns of personal data and credentials, in the order they are tried.
CARD, SSN = r"\b(?:[0-9][ -]*?){13,19}\b", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
NATIONAL = (r"\b[0-9]{5}-[0-9]{7}-[0-9]\b", r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b", r"\b[A-CEGHJ-PR-TW-Z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D]\b")
CREDENTIAL = r"(?i)(?:password|passwd|pwd)\s*[:=]\s*\S+|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bsk-(?:proj-|ant-|or-v1-)?[A-Za-z0-9_\-]{20,}\b"
REDACTED = "[REDACTED_PII]"
# Fixed patterns of instruction-like text.
INSTRUCTIONS = (
    r"(?is)\b(ignore|disregard|forget)\b.{0,40}\b(previous|prior|above|earlier|instructions?|prompts?|rules?)\b", r"(?i)\b(system|assistant|user)\s*:\s*",
    r"(?i)\bnew\s+instructions?\s*:", r"(?is)\b(reveal|print|output|leak|dump)\b.{0,30}\b(prompt|api|key|secret|password|token)\b",
    r"(?i)\byou\s+are\s+(now|no\s+longer)\b", r"<\|.*?\|>", r"\{\{.*?\}\}")
PLAIN_NUMBER = r"(?i)^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[e][+-]?[0-9]+|\s*(?:USD|EUR|GBP|PKR|INR|AED|SAR|JPY|CNY|CAD|AUD))?\s*$"


def strings(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def clean_records(df: DataFrame, currency: str | None = None, country: str | None = None) -> DataFrame:
    """Cleaned columns, <name>_raw / _currency / _normalized beside prices and dates, and an array `warnings`.

    A column's kind follows from its name, once per table; the result is one projection. Empty text is null.
    """
    out: list[Column] = []
    warnings: list[Column] = []
    for name in df.columns:
        if name not in strings(df):
            out.append(F.col(name))
            continue
        raw = T.blank_to_null(F.col(name))
        kind, clean = T.kind_of_column(name), T.normalize_text(raw)
        if kind == "currency":
            amount = T.amount_of(clean)
            out += [clean.alias(name), clean.alias(f"{name}_raw"), F.when(raw.isNotNull(), T.currency_of(clean, currency)).alias(f"{name}_currency"), amount.alias(f"{name}_normalized")]
            warnings.append(F.when(raw.isNotNull() & (clean != "") & amount.isNull(), f"{name}: no number"))
        elif kind == "date":
            iso = T.normalize_date(raw)
            out += [clean.alias(name), raw.alias(f"{name}_raw"), iso.alias(f"{name}_normalized"), F.when(iso.isNotNull(), T.is_real_date(iso)).alias(f"{name}_is_valid")]
            warnings.append(F.when(raw.isNotNull() & iso.isNull(), f"{name}: no date"))
        elif kind in ("email", "phone"):
            good = T.normalize_email(raw) if kind == "email" else T.normalize_phone(raw, country)
            out.append(F.coalesce(good, clean).alias(name))
            warnings.append(F.when(raw.isNotNull() & good.isNull(), f"{name}: no {kind}"))
        else:
            out.append(clean.alias(name))
    return df.select(*out, F.array_compact(F.array(*warnings)).alias("warnings") if warnings else F.array().cast("array<string>").alias("warnings"))


def identity(df: DataFrame, columns: Sequence[str] = IDENTITY) -> Column:
    """The first of the identity columns that holds something; null if none does."""
    found = [T.blank_to_null(F.col(c).cast("string")) for c in columns if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def with_identity(df: DataFrame, prefix: str = "rec_", key: Column | None = None) -> DataFrame:
    """Adds identity and record_id, a short digest of it; a row without identity has neither."""
    key = identity(df) if key is None else key
    return df.withColumn("identity", key).withColumn("record_id", F.concat(F.lit(prefix), F.substring(F.sha2("identity", 256), 1, 12)))


def guard_csv(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run get a leading quote; `sanitized_cells` counts them per row."""
    names = strings(df)
    risky = {c: F.coalesce(F.col(c).rlike(r"^[=+\-@\t\r\n]") & ~(F.col(c).rlike(r"^[+-]") & F.col(c).rlike(PLAIN_NUMBER)), F.lit(False)) for c in names}
    count = sum((r.cast("int") for r in risky.values()), F.lit(0))
    return df.select(*(F.when(risky[c], F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if c in risky else F.col(c) for c in df.columns), count.alias("sanitized_cells"))


def pii_kind(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    kind = F.when(c.rlike(CARD) & digits.between(13, 19), "credit_card").when(c.rlike(SSN), "ssn")
    for pattern in NATIONAL:
        kind = kind.when(c.rlike(pattern), "national_id")
    return kind.when(c.rlike(CREDENTIAL), "credential")


def redact_pii(df: DataFrame, declared: Sequence[str] = ()) -> DataFrame:
    """Undeclared text cells that hold personal data become [REDACTED_PII]; `findings` lists (field, kind)."""
    names = [c for c in strings(df) if c.lower() not in {d.lower() for d in declared}]
    kinds = {c: pii_kind(F.col(c)) for c in names}
    found = [F.when(kinds[c].isNotNull(), F.struct(F.lit(c).alias("field"), kinds[c].alias("kind"))) for c in names]
    return df.select(*(F.when(kinds[c].isNotNull(), REDACTED).otherwise(F.col(c)).alias(c) if c in kinds else F.col(c) for c in df.columns), F.array_compact(F.array(*found)).alias("findings"))


def null_injections(df: DataFrame, longest: int = 4000) -> DataFrame:
    """Text cells with instruction-like text or above `longest` characters become null; `suspect_fields` names them."""
    names = strings(df)
    bad = {}
    for c in names:
        hit = F.length(c) > longest
        for pattern in INSTRUCTIONS:
            hit = hit | F.col(c).rlike(pattern)
        bad[c] = F.coalesce(hit, F.lit(False))
    found = F.array_compact(F.array(*(F.when(bad[c], c) for c in names)))
    return df.select(*(F.when(~bad[c], F.col(c)).alias(c) if c in bad else F.col(c) for c in df.columns), found.alias("suspect_fields"))


def long_cells(df: DataFrame, key: str, skip: Sequence[str] = ()) -> DataFrame:
    """(key, field_name, value) of every column but key and skip, as text."""
    names = [c for c in df.columns if c != key and c not in skip]
    return df.select(key, *(F.col(c).cast("string").alias(c) for c in names)).unpivot(key, names, "field_name", "value")


def melt_observations(df: DataFrame, domain: Column, trust: Column) -> DataFrame:
    """Wide records with record_id as observations (record_id, field_name, source_domain, value, trust_score)."""
    wide = df.withColumns({"_domain": domain, "_trust": trust})
    names = [c for c in df.columns if c not in ("record_id", "identity", *BOOKKEEPING)]
    texts = wide.select("record_id", "_domain", "_trust", *(F.col(c).cast("string").alias(c) for c in names))
    return texts.unpivot(["record_id", "_domain", "_trust"], names, "field_name", "value").select(
        "record_id", "field_name", F.col("_domain").alias("source_domain"), "value", F.col("_trust").alias("trust_score"))


def build_provenance(df: DataFrame, url: Column, domain: Column, method: str, at: Column) -> DataFrame:
    """One lineage row per (record_id, field) with the raw value."""
    wide = df.withColumns({"_url": url, "_domain": domain, "_at": at})
    names = [c for c in df.columns if c not in ("record_id", "identity")]
    keys = ["record_id", "_url", "_domain", "_at"]
    cells = wide.select(*keys, *(F.col(c).cast("string").alias(c) for c in names)).unpivot(keys, names, "field_name", "raw_value")
    return cells.select("record_id", "field_name", F.col("_url").alias("source_url"), F.col("_domain").alias("source_domain"), F.lit(method).alias("extraction_method"), "raw_value", F.col("_at").alias("extracted_at"))


def provenance_lookup(provenance: DataFrame, record: str, field: str | None = None) -> DataFrame:
    hits = provenance.where(F.col("record_id") == record)
    return hits.where(F.col("field_name") == field) if field else hits
