"""All named queries and their SQL."""

from . import indexes, service  # noqa: F401  they add their queries to the catalogue's
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
