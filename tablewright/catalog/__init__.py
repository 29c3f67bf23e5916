"""All registered queries and their SQL twins."""

from . import (  # noqa: F401
    advanced_queries, clean_queries, describe_queries, diagnose_queries, predict_queries, prescribe_queries, reshape_queries, source_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
