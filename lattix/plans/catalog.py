"""Registered queries of the engine's own operators, each with the SQL that checks it."""

from __future__ import annotations

from lattix.plans import models, regional, spatial, tables


def queries() -> dict:
    return {k: v for m in (tables, spatial, models, regional) for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in (tables, spatial, models, regional) for k, v in m.SQL.items()}
