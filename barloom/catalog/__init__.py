"""Named queries over the driver tables, each with its SQL counterpart where SQL can express it."""

from barloom.catalog import alignment, chains, cleaning, evaluation, files, indicators, sessions, streams, training  # noqa: F401
from barloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
