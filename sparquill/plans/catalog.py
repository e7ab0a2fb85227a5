"""Every query of the search and analytics library, by name, with its SQL oracle."""

from __future__ import annotations

from . import analysis, corpus, search, tables  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
