"""All registered queries and their comparison SQL."""

from __future__ import annotations

import importlib

_PARTS = ["series", "ingest", "cross", "model", "agent", "learn", "stream"]


def _merge(kind: str, attribute: str) -> dict:
    out: dict = {}
    for part in _PARTS:
        out.update(getattr(importlib.import_module(f"tidebars.plans.{part}_{kind}"), attribute))
    return out


def queries() -> dict:
    return _merge("queries", "QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merge("sql", "SQL")
