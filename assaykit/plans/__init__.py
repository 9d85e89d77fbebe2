"""Queries of the library over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from assaykit.plans import aggregates, clusters, contrasts, judging, models, notes, places, readouts, releases, sampling, texts, variants  # noqa: F401
from assaykit.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
