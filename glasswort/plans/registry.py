"""Every query of the library by name, and its DuckDB counterpart."""

from __future__ import annotations

from importlib import import_module

MODULES = ("verdicts", "evaluation", "selection", "joins", "text_rules", "vectors", "provenance")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"glasswort.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
