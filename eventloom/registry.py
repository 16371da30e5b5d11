"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

from .plans import adaptation, core, incidents, streams, workspace

PARTS = [core, incidents, adaptation, workspace, streams]


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.Q.items()}


def oracle_sql() -> dict:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
