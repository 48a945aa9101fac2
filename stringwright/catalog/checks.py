"""All checked queries."""

from stringwright.catalog import modelled, processed, repairs, typed, whole  # noqa: F401
from stringwright.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
