"""Registered queries of the document-structure operators, and the SQL that must give the same rows."""

from . import checks, pages, registry, scalars, stored, structure

_PARTS = [structure, checks, scalars, registry, pages, stored]
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
