"""The registered queries: what each one computes on the given tables, and the same in SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("inputs", "columns", "basics", "portfolio", "facts", "search", "graph", "streams", "context")


def _loaded():
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return import_module(f"{__name__}.registry")


def queries() -> dict:
    return dict(_loaded().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_loaded().SQL)
