"""All registered queries of the analytics engine and their SQL twins."""

from __future__ import annotations

from tessera.plans import audits, catalogue, lookups, measures, names, overlays, places, records, search, states, streams  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
