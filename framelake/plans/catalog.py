"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from framelake.plans import collections, general, geometry, imports, more, scenes

MODULES = [general, collections, geometry, scenes, more, imports]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
