"""All named queries and their SQL twins."""

from . import decisions, features, indicators, inference, market, measures, models, regimes, rules, selection, series, streams  # noqa: F401  registers the queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
