"""All registered queries."""

from __future__ import annotations

from veinwork.plans import auditing, bundling, clearing, contracts, gating, geometry, grading, histories, logs, measuring, preparing, rulebook, scanning, selecting  # noqa: F401  they register their queries
from veinwork.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
