"""All queries over the reference's own operators, with their SQL."""

from __future__ import annotations

from . import abbreviations, desk, entities, incremental, relational, retrieval, scanners, search, short_forms, textual  # noqa: F401
from .registry import QUERIES, SQL, Query

FLAGSHIP = "rel_tracker_cases"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
