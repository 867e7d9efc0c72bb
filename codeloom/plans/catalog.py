"""All driver queries of the engine, by family."""

from __future__ import annotations

from collections.abc import Callable

FAMILIES: tuple[str, ...] = ("scan", "code", "checks", "runtime", "workflows")


def _collect(name: str) -> dict:
    import importlib

    out: dict = {}
    for f in FAMILIES:
        out.update(getattr(importlib.import_module(f"codeloom.plans.{f}"), name))
    return out


def queries() -> dict[str, Callable]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE_SQL")
