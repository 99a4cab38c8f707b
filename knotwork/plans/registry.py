"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from . import more, related  # noqa: F401  add their queries as they are imported
from .queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
