"""Folds and collectors as column expressions."""

from .folds import collectors, fold, ordered_values, scan, wrap32

__all__ = ["collectors", "fold", "ordered_values", "scan", "wrap32"]
