"""Whole-sequence aggregates; for each key, where there is one. An empty sequence gives no row unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fold, ordered_values, wrap32


class Aggregates:
    def _agg(self, *columns: Column) -> DataFrame:
        """Without a row for an empty sequence without key."""
        found = self.df.groupBy(*self.key).agg(F.count("*").alias("_n"), *columns)
        return found.where("_n > 0").drop("_n")

    def count(self, name: str = "count") -> DataFrame:
        """0 for an empty sequence."""
        return self.df.groupBy(*self.key).agg(F.count("*").alias(name))

    def sum_int(self, value: Column, name: str = "sum") -> DataFrame:
        """Wraps at 32 bits."""
        return self._agg(F.sum(value.cast("long")).alias("_sum")).select(*self.key, wrap32(F.col("_sum")).alias(name))

    def sum_long(self, value: Column, name: str = "sum") -> DataFrame:
        """Wraps at 64 bits: the sum is taken in decimals and reduced."""
        total, span = F.sum(value.cast("decimal(20,0)")).alias("_sum"), F.lit("18446744073709551616").cast("decimal(20,0)")
        low = F.pmod(F.col("_sum"), span)
        return self._agg(total).select(*self.key, F.when(low >= F.lit("9223372036854775808").cast("decimal(20,0)"), low - span).otherwise(low).cast("long").alias(name))

    def min(self, value: Column, name: str = "min") -> DataFrame:
        return self._agg(F.min(value).alias(name))

    def max(self, value: Column, name: str = "max") -> DataFrame:
        return self._agg(F.max(value).alias(name))

    def reduce(self, value: Column, step: Callable[[Column, Column], Column], seed: Column | None = None, name: str = "result") -> DataFrame:
        """An ordered fold; with a seed an empty sequence gives the seed (without key)."""
        values = ordered_values(value, self.order)
        if seed is not None:
            return self.df.groupBy(*self.key).agg(fold(values, seed, step).alias(name))
        found = self._agg(values.alias("_v"))
        return found.select(*self.key, fold(F.slice("_v", 2, F.size("_v")), F.element_at("_v", 1), step).alias(name))

    aggregate = reduce

    def collect(self, name: str = "result", **parts: Column) -> DataFrame:
        """A container of aggregates, as a struct."""
        return self.df.groupBy(*self.key).agg(F.struct(*(c.alias(k) for k, c in parts.items())).alias(name))

    def to_list(self, value: Column, name: str = "list") -> DataFrame:
        """The values in order; an empty list for an empty sequence without key."""
        return self.df.groupBy(*self.key).agg(ordered_values(value, self.order).alias(name))

    def collect_with(self, name: str = "result", **collected: Column) -> DataFrame:
        """Collectors (see functions.collectors), one column each; a single one takes ``name``."""
        if len(collected) == 1:
            collected = {name: next(iter(collected.values()))}
        return self.df.groupBy(*self.key).agg(*(c.alias(k) for k, c in collected.items()))
