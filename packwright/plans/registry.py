"""Collects the registered queries and their DuckDB oracles from every plan module."""

from __future__ import annotations

import importlib

MODULES = ("corpus", "instruct", "loading", "scores", "storage", "incremental")


def _modules():
    return [importlib.import_module(f"packwright.plans.{m}") for m in MODULES]


def queries() -> dict:
    q = {}
    for m in _modules():
        q.update(m.QUERIES)
    return q


def oracle_sql() -> dict:
    o = {}
    for m in _modules():
        o.update(m.ORACLES)
    return o
