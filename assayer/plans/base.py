"""Registry of named queries: input tables derived by plain SQL, an operator applied to them, and SQL with the same rows.

A fixture is one SELECT in the dialect that Spark SQL and DuckDB share; {name} stands for a table or another fixture.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FIXTURES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_NAME = re.compile(r"\{([a-z_]+)\}")


class Inputs:
    """Tables and fixtures of one data folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        known = self.__dict__["known"]
        if name not in known:
            if name in TABLES:
                known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = FIXTURES[name]
                known[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in set(_NAME.findall(sql))})
        return known[name]


def fixture(name: str, sql: str) -> None:
    FIXTURES[name] = sql


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in _NAME.findall(sql):
        if name in FIXTURES and name not in found:
            _needed(FIXTURES[name], found)
            found.append(name)
    return found


def oracle(sql: str) -> str:
    """sql with its fixtures as leading common table expressions."""
    parts = [f"{name} AS ({_NAME.sub(r'\1', FIXTURES[name]).replace('{{', '{').replace('}}', '}')})" for name in _needed(sql, [])]
    body = _NAME.sub(r"\1", sql).strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        parts.append(re.sub(r"(?i)^WITH( RECURSIVE)?\s+", "", body))
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)
    return (f"WITH {',\n'.join(parts)}\n" if parts else "") + body


def query(name: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(sql)
