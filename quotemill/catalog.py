"""Every registered query of the library, with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotemill.plans import attributes, characteristics, collection, comparison, dates, extraction, facts, history, imports, pages, publications, validation, webtext
from quotemill.sources import views

FLAGSHIP = "jo2_latest_check"


def _with_views(sql: str) -> str:
    """Puts the domain tables that the SQL names before it."""
    used = [f"{name} as ({text})" for name, text in views.SQL.items() if re.search(rf"\b(from|join)\s+{name}\b", sql)]
    if not used:
        return sql
    if sql.lstrip().lower().startswith("with recursive "):
        return "with recursive " + ", ".join(used) + ", " + sql.lstrip()[15:]
    if sql.lstrip().lower().startswith("with "):
        return "with " + ", ".join(used) + ", " + sql.lstrip()[5:]
    return "with " + ", ".join(used) + " " + sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for module in (history, collection, comparison, attributes, dates, facts, imports, pages, publications, webtext, extraction, characteristics, validation):
    QUERIES |= module.QUERIES
    SQL |= {name: _with_views(sql) for name, sql in module.SQL.items()}
