"""Every registered query of the retrieval and audit operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.plans import audits, building, handover, retrieval, search, timeline

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

for module in (retrieval, search, timeline, audits, handover, building):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
