"""Queries over the given tables, each next to the SQL that must give the same rows."""

from checks import cleaning, reports, roundtrips, texts  # noqa: F401  (registration)
from checks.registry import REGISTRY

__all__ = ["REGISTRY"]
