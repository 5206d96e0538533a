"""All queries of the library and their SQL."""

from . import assets, pages, parsers, tables, text  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
