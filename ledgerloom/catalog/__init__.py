"""Named queries with their SQL oracles."""

from __future__ import annotations

import importlib

GROUPS = ("metrics", "tables", "documents", "xbrl", "jobs")


def all_queries() -> dict:
    found = {}
    for group in GROUPS:
        found.update(importlib.import_module(f"ledgerloom.catalog.{group}").QUERIES)
    return found
