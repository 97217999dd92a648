"""Queries over the given tables, each next to its reference SQL."""

from . import aggregates, cleaning, composites, joins, models, ordering, scalars, sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
