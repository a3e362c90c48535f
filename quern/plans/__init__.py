"""Registered queries and their SQL twins."""

from __future__ import annotations

from quern.plans import archives, catalog, formats, metrics, raster

MODULES = (catalog, raster, metrics, formats, archives)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
