"""Registered queries and the SQL that states them independently."""

from . import events, graph, search, texts  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
