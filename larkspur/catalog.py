"""The registry of the engine's own queries, and what DuckDB says to them."""

from __future__ import annotations

from larkspur.plans import code, formats, retrieval, storage, symbols

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (retrieval, code, symbols, storage, formats):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
