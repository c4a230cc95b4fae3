"""Training-data operators: sampling, deduplication, search, tokenising.

Nothing outside this folder imports it.  ``queries()`` and ``oracle_sql()``
gather what the operator modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "mixing",
    "line_dedup",
    "sharding",
    "fingerprint",
    "secrets",
    "suffix_dedup",
    "language_id",
    "topk",
    "minhash",
    "bpe",
)


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").ORACLE
    return found
