"""Operators for training data. Nothing outside this subpackage imports it.

The modules are imported at once, so that a missing dependency shows where the subpackage is imported.
"""

from __future__ import annotations

import tiktoken  # noqa: F401  needed in tasks
import xxhash  # noqa: F401

from . import abuse, budget, encoding, leakage, lookalike, packing, sentences, splitting

_MODULES = (lookalike, budget, splitting, sentences, encoding, packing, leakage, abuse)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
