"""Named queries of the core and their SQL twins, by module."""

from __future__ import annotations

from ..functions.numbers import rounded_sql
from . import analysis, evaluation, ingest, integrity, retrieval

MODULES = (integrity, retrieval, evaluation, analysis, ingest)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: rounded_sql(sql) for module in MODULES for name, sql in module.SQL.items()}
