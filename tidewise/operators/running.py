"""Scans and distinct values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import ordered_values, scan
from ..plans.order import neighbour, ordering, running


class Running:
    def scan(self, kind: str, value: Column, seed, name: str = "acc", position: str = "pos"):
        """The seed, then the running sum, min, max or last joined with it: one row more than the sequence, for each key.

        ``position`` counts from 0 and is the new order.
        """
        joined = {"sum": lambda a: F.lit(seed) + F.coalesce(a, F.lit(0)), "min": lambda a: F.least(F.lit(seed), a), "max": lambda a: F.greatest(F.lit(seed), a), "last": lambda a: F.coalesce(a, F.lit(seed))}[kind]
        found = running(self.df, self.order, self.key, {"_acc": (kind, value), "_pos": ("count", F.lit(1))})
        rows = found.select(*self.key, F.col("_pos").cast("long").alias(position), joined(F.col("_acc")).alias(name))
        first = self.df.select(*self.key).distinct() if self.key else self.df.sparkSession.range(1).select()
        kinds = dict(rows.dtypes)
        seeds = first.select(*self.key, F.lit(0).cast("long").alias(position), F.lit(seed).cast(kinds[name]).alias(name))
        return self.with_df(rows.unionByName(seeds), order=(position,))

    def scan_fold(self, value: Column, seed: Column, step: Callable[[Column, Column], Column], name: str = "acc", position: str = "pos"):
        """As scan, for any step; gathers one key's values."""
        found = self.df.groupBy(*self.key).agg(scan(ordered_values(value, self.order), seed, step).alias("_all"))
        rows = found.select(*self.key, F.posexplode("_all").alias("_p", name)).withColumn(position, F.col("_p").cast("long")).drop("_p")
        return self.with_df(rows, order=(position,))

    def accumulate(self, kind: str, value: Column, name: str = "acc"):
        """The running sum, count, min, max or last; as many rows as the sequence."""
        return self.with_df(running(self.df, self.order, self.key, {name: (kind, value)}))

    def distinct(self, *by: str):
        """The first row of each combination of values (of the whole row without order, if none are named)."""
        by = by or tuple(self.values)
        first = F.row_number().over(Window.partitionBy(*self.key, *by).orderBy(*ordering(self.order)))
        return self.with_df(self.df.withColumn("_first", first).where("_first = 1").drop("_first"))

    def distinct_until_changed(self, *by: str | Column):
        """Rows whose values differ from the row before; a leading null counts as no change and goes."""
        by = tuple(F.col(b) if isinstance(b, str) else b for b in by) or tuple(F.col(c) for c in self.values)
        items = {f"_before{k}": b for k, b in enumerate(by)}
        found = neighbour(self.df, self.order, self.key, items)
        changed = F.lit(False)
        for k, b in enumerate(by):
            changed = changed | ~F.col(f"_before{k}").eqNullSafe(b)
        return self.with_df(found.where(changed).drop(*items))
