"""All queries of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pagewright.plans import documents, formats, layout, packages, rules, texts

_ALL = texts.QUERIES | layout.QUERIES | rules.QUERIES | formats.QUERIES | documents.QUERIES | packages.QUERIES


def queries() -> dict[str, Callable]:
    return {name: made for name, (made, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
