"""Ordered folds as higher-order column functions, and the usual collectors as aggregates.

``fold`` and ``scan`` gather one group's values; use them for groups of bounded size (a user, a session). For sums, minima and
the like use the aggregates, which need no gathering. An opaque Python fold goes through ``applyInPandas`` on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_values(value: Column, order: Sequence[str]) -> Column:
    """Aggregate: the group's values in order."""
    gathered = F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), value.alias("v"))))
    return F.transform(gathered, lambda s: s["v"])


def fold(values: Column, seed: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    return F.aggregate(values, seed, step, finish) if finish else F.aggregate(values, seed, step)


def scan(values: Column, seed: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The seed and every intermediate result; quadratic in the group's size (arrays are copied)."""
    return F.aggregate(values, F.array(seed), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))


def wrap32(total: Column) -> Column:
    """A 64-bit total as a 32-bit adder would have wrapped it."""
    low = total.bitwiseAND(F.lit(4294967295))
    return F.when(low >= 2147483648, low - 4294967296).otherwise(low).cast("int")


class collectors:
    """Aggregates that stand for the well-known collectors."""

    counting = staticmethod(lambda: F.count("*"))
    summing = staticmethod(lambda value: F.sum(value))
    averaging = staticmethod(lambda value: F.avg(value))
    to_set = staticmethod(lambda value: F.array_sort(F.collect_set(value)))
    to_list = staticmethod(lambda value, order: ordered_values(value, order))
    joining = staticmethod(lambda value, order, separator="": F.array_join(ordered_values(value, order), separator))
    partitioning = staticmethod(lambda test: F.create_map(F.lit(True), F.count(F.when(test, 1)), F.lit(False), F.count(F.when(~test, 1))))
    minimum = staticmethod(lambda value: F.min(value))
    maximum = staticmethod(lambda value: F.max(value))
