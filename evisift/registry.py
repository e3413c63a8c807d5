"""Queries of the engine's own operators and their SQL."""

from __future__ import annotations

from evisift.catalog import effects, extraction, records, reporting, review, screening, sources, units

MODULES = (units, screening, records, effects, extraction, review, reporting, sources)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
