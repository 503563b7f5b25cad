"""Registered queries: each operator on the star tables, with its SQL twin."""

from . import advanced, basic, control  # noqa: F401  (they fill the registry)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
