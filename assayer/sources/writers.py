"""Writing record tables, reports and histories."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.sources.commits import commit, committed, discard

FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without nesting."""
    return df.select(*(F.to_json(F.col(n)).alias(n) if t.startswith(("array", "map", "struct")) else F.col(n) for n, t in df.dtypes))


def write_records(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> str:
    """Writes csv, json, jsonl or parquet, by fmt or the path's suffix; csv has a header and empty text for null."""
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    writer = (flat(df) if fmt == "csv" else df).write.mode(mode).format(FORMATS[fmt])
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"')
    writer.save(path)
    return path


def write_idempotent(df: DataFrame, target: str, ledger: str, key: str) -> tuple[str, bool]:
    """(where, written): the rows of a key are delivered once; a later call gives the first place again; no rows, no write.

    Rows are written to a folder of their own below target, then one ledger file is committed that names it. Of two writers
    of a key one commits; the other takes its own folder away and gives the first's place. Readers go by the place of the
    ledger, which never changes nor is written over; a failure before the commit leaves no ledger entry, and the key is free.
    """
    spark, name = df.sparkSession, hashlib.sha256(key.encode()).hexdigest()
    entry = f"{ledger.rstrip('/')}/{name}.json"
    known = committed(spark, entry)
    if known:
        return known["place"], False
    if df.isEmpty():
        return "", False
    place = f"{target.rstrip('/')}/{name[:16]}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    if commit(spark, entry, {"key": key, "place": place}):
        return place, True
    discard(spark, place)
    return committed(spark, entry)["place"], False


def append_run_history(df: DataFrame, path: str, query: str, client_id: str, created_at: str) -> None:
    """One JSON payload row per record, partitioned by client."""
    rows = df.select(F.lit(query).alias("query"), F.lit(created_at).cast("timestamp").alias("created_at"), F.to_json(F.struct(*df.columns)).alias("data"), F.lit(client_id).alias("client_id"))
    rows.write.mode("append").partitionBy("client_id").parquet(path)


def run_report(records: DataFrame, changes: DataFrame | None = None, provenance: DataFrame | None = None, report: DataFrame | None = None, verdict: DataFrame | None = None, metadata: Mapping[str, object] | None = None,
               errors: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of a run's report: data, changes, sources, quality, confidence, run_summary, errors, those that have something to say.

    changes: classify_changes, one row per changed field, with a summary from the record's names; provenance: build_provenance;
    report and verdict: quality_report and quality_verdict, as (part, name, value, passed). confidence has the record's name and
    its columns confidence and *_confidence, if there are any.
    """
    spark = records.sparkSession
    tables = {"data": records}
    if changes is not None:
        none = F.array(F.struct(*(F.lit("").alias(c) for c in ("field", "old", "new"))))
        detail = F.when(F.col("change_type") != "MODIFIED", none).when(F.size("field_changes") == 0, F.array(F.struct(F.lit("(no field detail)").alias("field"), F.lit("").alias("old"), F.lit("").alias("new")))).otherwise(F.col("field_changes"))
        told = changes.where("change_type <> 'UNCHANGED'")
        tables["changes"] = told.select(F.col("change_type").alias("status"), "identity", F.explode(detail).alias("c")).select("status", "identity", "c.*")
    if provenance is not None:
        names = {"field_name": "field", "source_domain": "domain", "extraction_method": "method"}
        order = ("record_id", "field_name", "source_url", "source_domain", "observed_at", "fetched_at", "extracted_at", "extraction_method", "raw_value", "normalized_value", "confidence")
        tables["sources"] = provenance.select(*(F.col(c).alias(names.get(c, c)) for c in order if c in provenance.columns))
    parts = []
    if verdict is not None:
        rows = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (
            ("passed", F.when(F.col("passed"), "YES").otherwise("NO")), ("score", F.col("score").cast("string")), ("suggested_action", F.col("action")),
            ("failed_rules", F.coalesce(F.nullif(F.array_join("failed_rules", ", "), F.lit("")), F.lit("(none)"))))))
        parts.append(verdict.select(F.inline(rows)).select(F.lit("verdict").alias("part"), "name", "value", F.lit(None).cast("string").alias("passed")))
    if report is not None:
        parts.append(report.select(F.lit("rule").alias("part"), F.col("rule").alias("name"), F.col("value").cast("string").alias("value"), F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("passed")))
    if parts:
        tables["quality"] = reduce(DataFrame.unionByName, parts)
    scores = sorted(c for c in records.columns if c == "confidence" or c.endswith("_confidence"))
    if scores:
        name = next((c for c in ("title", "business_name", "name", "url") if c in records.columns), None)
        tables["confidence"] = records.select(*([name] if name else []), *scores)
    tables["run_summary"] = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted((metadata or {}).items())], "field string, value string")
    if errors:
        tables["errors"] = spark.createDataFrame([(str(e),) for e in errors], "message string")
    return tables


def write_report_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """The tables of a run report as Parquet; confidence only if it has a confidence column."""
    written = []
    for name, df in tables.items():
        if name == "confidence" and not any(c == "confidence" or c.endswith("_confidence") for c in df.columns):
            continue
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
        written.append(name)
    return written
