"""Ordered-sequence analytics on PySpark."""

from .seq import Seq

__all__ = ["Seq"]
