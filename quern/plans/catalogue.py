"""All registered queries of the engine proper, with their DuckDB equivalents."""

from __future__ import annotations

from quern.plans import accuracy, boards, checks, commands, metrics, scans, splits, streams, tasks, timelines, trajectories, trees  # noqa: F401  (they register)
from quern.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
