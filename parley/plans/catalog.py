"""Names of the engine's queries, each with its plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from parley.plans import alignment, analysis, dialogue, events

_MODULES = (dialogue, analysis, alignment, events)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
