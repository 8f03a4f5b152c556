"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("detection", "measurement", "preparation", "comparison")


def _all() -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= import_module(f"maskloom.plans.{name}").QUERIES
    return out


def queries() -> dict:
    return {name: function for name, (function, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
