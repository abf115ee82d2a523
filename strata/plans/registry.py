"""All queries of the medallion operators and their SQL."""

from __future__ import annotations

from strata.plans import churn, gold, ingest, models, silver, staging

MODULES = [staging, silver, gold, churn, ingest, models]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
