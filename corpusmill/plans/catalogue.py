"""All queries over the sample tables, by name, with their SQL where there is one."""

from __future__ import annotations

from . import corpus, evaluation, metrics, records, vocabulary  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
