"""The queries over the driver's tables that show each operator at work."""

from . import dataset_queries, relational_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
