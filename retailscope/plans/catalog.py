"""Importing this module registers every query."""

from retailscope.plans import kpi, primitives, quality, retrieval, risk, sales, segments  # noqa: F401
from retailscope.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
