"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from loomstar.llm.queries import QUERIES
from loomstar.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
