"""Named queries over the warehouse tables, each with an SQL statement of the same result."""

from . import graphs, lists, metrics, models, prepare, trained  # noqa: F401  (they register themselves)
from .registry import QUERIES, oracles

ORACLES = oracles()

__all__ = ["ORACLES", "QUERIES"]
