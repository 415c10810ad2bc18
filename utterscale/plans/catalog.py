"""All registered queries."""

from __future__ import annotations

from utterscale.plans import corpus, logs, scoring, texts  # noqa: F401  (registers)
from utterscale.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
