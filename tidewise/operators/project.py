"""One-to-one and one-to-many maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import neighbour, overlapping, running

#: What an error of a row's mapping does: ends the sequence there, or waits for the end and only costs the row itself.
MODES = ("immediate", "boundary", "end")


class Project:
    def map(self, strict: bool = False, **columns: Column):
        """Each row to the given values; strict: a null value fails the job."""
        if strict:
            columns = {k: F.when(c.isNull(), F.raise_error(F.lit(f"map: {k} is null"))).otherwise(c) for k, c in columns.items()}
        return self.with_df(self.df.select(*self.positions, *(c.alias(k) for k, c in columns.items())))

    def _without_errors(self, error: Column | None, mode: str) -> DataFrame:
        """The rows that are mapped: those before the first error, or with mode end all that don't fail (null is no error)."""
        if mode not in MODES:
            raise ValueError(f"an error mode is one of {MODES}")
        if error is None:
            return self.df
        failed = F.coalesce(error, F.lit(False))
        if mode == "end":
            return self.df.where(~failed)
        found = running(self.df, self.order, self.key, {"_failed": ("max", failed.cast("int"))})
        return found.where("_failed = 0").drop("_failed")

    def errors(self, error: Column, name: str = "errors") -> DataFrame:
        """How many rows fail (0 where none does): what a delayed error reports at the end."""
        return self.df.groupBy(*self.key).agg(F.count(F.when(error, 1)).alias(name))

    def flat_map(self, values: Column, name: str = "value", error: Column | None = None, delay_error: bool = False):
        """Each row to the elements of an array; their mutual order isn't defined. Empty and null arrays give no row.

        error: which rows fail to map. Without delay_error the sequence ends before the first of them, with it only they are missing.
        """
        rows = self._without_errors(error, "end" if delay_error else "immediate")
        return self.with_df(rows.select(*self.positions, F.explode(values).alias(name)))

    def flat_map_relation(self, inner: DataFrame, on: Column, how: str = "inner"):
        """Each row to the rows of a relation that meet a condition."""
        return self.with_df(self.df.join(inner, on, how))

    def concat_map(self, values: Column, name: str = "value", position: str = "pos", error: Column | None = None, mode: str = "immediate"):
        """As flat_map, but in order: the element's position follows the row's order. mode: one of MODES; rows are mapped whole, so a boundary is at once."""
        return self.with_df(self._without_errors(error, mode).select(*self.positions, F.posexplode(values).alias(position, name)), order=(*self.order, position))

    def flat_map_iterable(self, values: Column, name: str = "value", position: str = "pos"):
        return self.concat_map(values, name, position)

    concat_map_iterable = flat_map_iterable

    def switch_map(self, inner: DataFrame, time: str, inner_time: str, on: list[str] | None = None):
        """Rows of ``inner`` from each row's time until the next row's; a new row ends the one before.

        ``inner`` has the key columns and its own time; ``on`` further shared columns (e.g. which inner is meant).
        """
        spans = neighbour(self.df, self.order, self.key, {"_until": F.col(time)}, after=True)
        shared = [*self.key, *(on or [])]
        # inner rows are spans of one unit, joined by cells of time
        points = inner.withColumn("_end", F.col(inner_time) + 1)
        found = overlapping(spans, points, shared, (time, "_until"), (inner_time, "_end"))
        return self.with_df(found.drop("_until", "_end"), order=(inner_time,))

    def lift(self, function: Callable[[DataFrame], DataFrame]):
        """A user's operator on the table."""
        return self.with_df(self.df.transform(function))

    def compose(self, function):
        """Apply a function of the sequence."""
        return function(self)

    as_ = compose

    def hide(self):
        """The sequence itself; there is no type to hide."""
        return self.with_df(self.df.select("*"))
