"""Every registered query and, where SQL can express it, its twin in SQL."""

from __future__ import annotations

from .plans import ask, evaluation, feeds, jobs, quotes, retrieval, sequences, usage  # noqa: F401  (they register their queries)
from .plans.base import ORACLES, QUERIES, Plan


def queries() -> dict[str, Plan]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
