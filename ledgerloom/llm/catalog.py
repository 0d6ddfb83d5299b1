"""The queries of this subpackage with their SQL oracles, by module."""

from __future__ import annotations

import importlib

MODULES = (
    "block_search", "quality", "token_counts", "packing", "token_files", "warc", "language", "jaccard", "secrets", "byte_bpe",
    "dialogue", "collocations", "passages",
)


def llm_queries() -> dict:
    found = {}
    for module in MODULES:
        found.update(importlib.import_module(f"ledgerloom.llm.{module}").QUERIES)
    return found
