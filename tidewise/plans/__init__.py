"""Lowering patterns: everything order-sensitive becomes a few window, union and interval-join shapes."""
