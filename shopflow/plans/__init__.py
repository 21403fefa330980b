"""Models, analytical queries and data tests over the shop's relations."""

from . import analytics, catalog  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
