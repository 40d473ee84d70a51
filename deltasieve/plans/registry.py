"""All queries of the library's own operators, by name."""

from __future__ import annotations

from . import code, core, intake, review

_MODULES = (core, code, review, intake)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
