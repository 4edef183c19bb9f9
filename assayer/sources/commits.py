"""Small files that only one writer can create, and bodies of Parquet files that they point to.

A commit is one file with JSON text. It is written beside its place and moved there without replacing anything: of two
writers one wins, and a reader sees all of it or none. Needs a file system that moves atomically (HDFS, a local disk).
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def commit(spark: SparkSession, path: str, value: dict) -> bool:
    """Writes value as the file at path; False if there is one already, which stays."""
    fs, place = _at(spark, path)
    if fs.exists(place):
        return False
    fs.mkdirs(place.getParent())
    _, draft = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.getScheme() != "file":
        won = fs.rename(draft, place)
        if not won:
            fs.delete(draft, False)
        return bool(won)
    try:  # a local rename would replace the file, a link does not
        os.link(draft.toUri().getPath(), place.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


def committed(spark: SparkSession, path: str) -> dict | None:
    """The value at path, or None if nothing was committed there."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commits(spark: SparkSession, folder: str) -> list[str]:
    """Names of the commits of a folder, in order."""
    fs, place = _at(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(place)) if n.endswith(".json"))


def discard(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)
