"""Registered queries: one or more per operator, most with a check query."""

from strandlab.catalog.base import CHECKS, QUERIES
from strandlab.catalog import batching, classifying, comparing, features, files, preparing, representing, scoring  # noqa: F401

__all__ = ["CHECKS", "QUERIES"]
