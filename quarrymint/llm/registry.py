"""Queries and SQL counterparts of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = (
    "neighbour_queries",
    "topn_queries",
    "parsing_queries",
    "split_queries",
    "overlap_queries",
    "packing_queries",
    "mixing_queries",
    "chunking_queries",
)


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quarrymint.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
