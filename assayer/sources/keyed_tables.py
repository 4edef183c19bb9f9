"""Tables by key in hash buckets, of which an update rewrites only those that it touches.

A table is a folder: data/<id>/_bucket=<n>/ holds Parquet files, manifest/<version>.json names for each bucket the folder
that counts. A new version is one committed file, so readers see the old state or the new one; what older versions name stays
until remove_unused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.operators.versions import upsert_latest
from assayer.sources.commits import commit, commits, committed, discard


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _place(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/manifest/{version:010d}.json"


def _current(spark: SparkSession, path: str) -> tuple[int, dict]:
    names = commits(spark, f"{path.rstrip('/')}/manifest")
    if not names:
        raise ValueError(f"no table at {path}")
    version = int(names[-1].removesuffix(".json"))
    return version, committed(spark, _place(path, version))


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> str:
    body = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(body)
    return body


def create_table(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """A table with the rows of df, one per key; an error if there is a table already."""
    if commits(df.sparkSession, f"{path.rstrip('/')}/manifest"):
        raise ValueError(f"there is a table at {path}")
    body = _write(df, path, keys, buckets)
    filled = [r[0] for r in df.select(_bucket(keys, buckets)).distinct().collect()]  # at most `buckets`
    if not commit(df.sparkSession, _place(path, 1), {"keys": list(keys), "buckets": buckets, "schema": df.schema.json(), "parts": {str(b): f"{body}/_bucket={b}" for b in filled}}):
        discard(df.sparkSession, body)
        raise ValueError(f"there is a table at {path}")


def read_table(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of the current version, or of some of its buckets."""
    return _rows(spark, _current(spark, path)[1], only)


def _rows(spark: SparkSession, table: dict, only: Sequence[int] | None) -> DataFrame:
    schema = StructType.fromJson(json.loads(table["schema"]))
    parts = [p for b, p in table["parts"].items() if only is None or int(b) in set(only)]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def upsert_table(updates: DataFrame, path: str, seq: str, keep: Sequence[str] = (), tries: int = 5) -> list[int]:
    """Merges updates by key (upsert_latest) and returns the buckets that were rewritten; all others keep their files.

    Several writers may start from one version: the first to commit wins, the others merge anew from its result, `tries`
    times at most. A failure before the commit leaves the table as it was.
    """
    spark = updates.sparkSession
    for _ in range(tries):
        version, table = _current(spark, path)
        keys, buckets = table["keys"], table["buckets"]
        touched = sorted(r[0] for r in updates.select(_bucket(keys, buckets)).distinct().collect())  # at most `buckets`
        if not touched:
            return []
        body = _write(upsert_latest(_rows(spark, table, touched), updates, keys, seq, keep), path, keys, buckets)
        if commit(spark, _place(path, version + 1), table | {"parts": table["parts"] | {str(b): f"{body}/_bucket={b}" for b in touched}}):
            return touched
        discard(spark, body)
    raise RuntimeError(f"{path} was changed by others {tries} times")


def remove_unused(spark: SparkSession, path: str) -> None:
    """Deletes what only older versions name; to be run when no reader has one open, and no writer is at work."""
    version, table = _current(spark, path)
    live = {p.rsplit("/", 2)[1] for p in table["parts"].values()}
    for old in range(1, version):
        for part in (committed(spark, _place(path, old)) or {"parts": {}})["parts"].values():
            if part not in table["parts"].values():
                discard(spark, part if part.rsplit("/", 2)[1] in live else part.rsplit("/", 1)[0])
        discard(spark, _place(path, old))
