"""Named queries over the given tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from assayer.plans import alerts, cleaning, crawl, leads, ledgers, metering, pages, quality, sources, streams, texts, trust, versions  # noqa: F401
from assayer.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
