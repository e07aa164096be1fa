"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import CATALOGUE


def queries() -> dict:
    return {name: query for name, (query, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
