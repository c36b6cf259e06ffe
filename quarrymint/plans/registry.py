"""The core's queries and SQL counterparts, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("nested_queries", "rollup_queries", "scalar_queries", "join_queries", "order_queries", "io_queries", "model_queries", "tree_queries", "record_queries")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quarrymint.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
