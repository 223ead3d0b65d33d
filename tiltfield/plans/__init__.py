"""Registered queries over the standard tables, and the SQL that they agree with."""

from .oracle import ORACLE_SQL
from .queries import FLAGSHIP, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
