"""The core's queries and their SQL, gathered from the modules beside this one."""
from __future__ import annotations

import importlib

MODULES: list[str] = ["quantities", "judging", "searching", "tables", "moving", "reading", "verifying", "reviewing", "checking"]


def gather() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"attestia.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
