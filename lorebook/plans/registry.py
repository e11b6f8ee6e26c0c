"""All registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "content", "logs", "decisions", "streams", "files")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"{__package__}.{module}"), name)
        assert not (out.keys() & part.keys()), module
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
