"""Registered queries of the library's operators, by family, and the SQL they equal."""

from __future__ import annotations

from tidalspan.plans import analysis, library, models, more, relational, series


def _families() -> tuple:
    return relational, series, analysis, models, more, library


def queries() -> dict:
    return {k: v for family in _families() for k, v in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for family in _families() for k, v in family.SQL.items()}
