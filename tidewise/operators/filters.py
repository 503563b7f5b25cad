"""Predicates, slices and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import keyed_join, numbered, running


def _flag(test: Column) -> Column:
    return F.coalesce(test.cast("int"), F.lit(0))


class Filters:
    def filter(self, test: Column):
        return self.with_df(self.df.where(test))

    def _place(self, reverse: bool = False) -> DataFrame:
        return numbered(self.df, self.order, self.key, "_n", reverse)

    def _slice(self, test: Column, reverse: bool = False):
        return self.with_df(self._place(reverse).where(test).drop("_n"))

    def take(self, n: int):
        if n < 0:
            raise ValueError("n >= 0 required")
        if not self.key:
            return self.with_df(self.df.orderBy(*self.order).limit(n))
        return self._slice(F.col("_n") < n)

    def take_last(self, n: int):
        if n < 0:
            raise ValueError("n >= 0 required")
        if not self.key:
            return self.with_df(self.df.orderBy(*(F.desc(c) for c in self.order)).limit(n))
        return self._slice(F.col("_n") < n, reverse=True)

    def skip(self, n: int):
        return self._slice(F.col("_n") >= n)

    def skip_last(self, n: int):
        return self._slice(F.col("_n") >= n, reverse=True)

    def _seen(self, test: Column, exclusive: bool = False) -> DataFrame:
        return running(self.df, self.order, self.key, {"_seen": ("max", _flag(test))}, exclusive=exclusive)

    def take_while(self, test: Column):
        """Rows before the first that fails the test (null fails)."""
        return self.with_df(self._seen(~F.coalesce(test, F.lit(False))).where("_seen = 0").drop("_seen"))

    def take_until(self, test: Column):
        """Rows up to and with the first that meets the test."""
        return self.with_df(self._seen(test, exclusive=True).where("coalesce(_seen, 0) = 0").drop("_seen"))

    def skip_while(self, test: Column):
        return self.with_df(self._seen(~F.coalesce(test, F.lit(False))).where("_seen = 1").drop("_seen"))

    def _gate(self, other: DataFrame, time: str, other_time: str) -> DataFrame:
        """With _gate: the other's first time, for each key; null where it has none."""
        first = F.min(other_time).alias("_gate")
        if not self.key:
            return self.df.crossJoin(F.broadcast(other.agg(first)))  # one row
        return keyed_join(self.df, other.groupBy(*self.key).agg(first), self.key, "left")

    def take_until_other(self, other: DataFrame, time: str, other_time: str):
        """Rows before the other's first row; all, where it has none and never ends."""
        return self.with_df(self._gate(other, time, other_time).where(F.col("_gate").isNull() | (F.col(time) < F.col("_gate"))).drop("_gate"))

    def skip_until_other(self, other: DataFrame, time: str, other_time: str):
        """Rows from the other's first row on."""
        return self.with_df(self._gate(other, time, other_time).where(F.col(time) >= F.col("_gate")).drop("_gate"))

    def element_at(self, index: int, default: dict | None = None, strict: bool = False):
        """The row at a place from 0. A short sequence gives no row, its default, or with strict an error (unkeyed)."""
        if index < 0:
            raise ValueError("index >= 0 required")
        found = self._slice(F.col("_n") == index)
        if default is not None:
            return found.default_if_empty(default)
        return found.with_df(_needed(found.df, "element_at: the sequence is too short")) if strict else found

    def next(self):
        return self.take(1)

    def single(self, default: dict | None = None) -> DataFrame:
        """The only row; more rows fail the job, none gives the default or fails (unkeyed)."""
        row = F.struct(*self.df.columns)
        grouped = self.df.groupBy(*self.key).agg(F.count("*").alias("_count"), F.min_by(row, F.struct(*self.order)).alias("_row"))
        wrong = F.when(F.col("_count") > 1, F.raise_error(F.lit("single: more than one row"))).otherwise(F.col("_row"))
        if self.key:
            return grouped.select(wrong.alias("_row")).select("_row.*")
        if default is None:
            wrong = F.when(F.col("_count") == 0, F.raise_error(F.lit("single: no row"))).otherwise(wrong)
            return grouped.select(wrong.alias("_row")).select("_row.*")
        given = F.struct(*(F.lit(default.get(f.name)).cast(f.dataType).alias(f.name) for f in self.df.schema))
        return grouped.select(F.when(F.col("_count") == 0, given).otherwise(wrong).alias("_row")).select("_row.*")

    def ignore_elements(self):
        """No rows; errors of evaluating them still show if the source is written to the noop sink (see sinks.drain)."""
        return self.with_df(self.df.where(F.lit(False)))

    def all(self, test: Column, name: str = "all") -> DataFrame:
        return self.df.groupBy(*self.key).agg(F.coalesce(F.bool_and(F.coalesce(test, F.lit(False))), F.lit(True)).alias(name))

    def any(self, test: Column, name: str = "any") -> DataFrame:
        return self.df.groupBy(*self.key).agg(F.coalesce(F.bool_or(test), F.lit(False)).alias(name))

    def exists(self, column: str, value, name: str = "exists") -> DataFrame:
        return self.any(F.col(column) == F.lit(value), name)

    def has_elements(self, name: str = "has_elements") -> DataFrame:
        """Whether there is a row; reads one row of a sequence without key."""
        if self.key:
            return self.df.groupBy(*self.key).agg(F.lit(True).alias(name))
        return self.df.select(F.lit(1).alias("_one")).limit(1).agg((F.count("*") > 0).alias(name))

    def is_empty(self, name: str = "is_empty") -> DataFrame:
        return self.has_elements("_has").select(*self.key, (~F.col("_has")).alias(name))

    def default_if_empty(self, row: dict):
        given = self.df.sparkSession.range(1).select(*(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in self.df.schema))
        return self.switch_if_empty(given)

    def switch_if_empty(self, other: DataFrame):
        """The sequence, or where it has no row another (of the same columns); without regard to keys."""
        none = self.df.select(F.lit(1).alias("_one")).limit(1).agg((F.count("*") == 0).alias("_none"))
        instead = other.crossJoin(F.broadcast(none)).where("_none").drop("_none")  # one row
        return self.with_df(self.df.unionByName(instead))


def _needed(df: DataFrame, message: str) -> DataFrame:
    """The one-row table, or an error if it has none."""
    row = df.agg(F.max(F.struct(*df.columns)).alias("_row"), F.count("*").alias("_n"))
    return row.select(F.when(F.col("_n") == 0, F.raise_error(F.lit(message))).otherwise(F.col("_row")).alias("_row")).select("_row.*")
