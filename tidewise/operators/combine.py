"""Concatenation, merge, zip, latest-value and overlap joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import grouped, keyed_join, numbered, overlapping, running, tagged


class Combine:
    def concat_with(self, *others: DataFrame, source: str = "source_index", error: Column | None = None, delay_error: bool = False):
        """The sequences one after another: the source's number leads the order.

        error: which rows are errors. Without delay_error the whole ends before the first of them; with it only its own source does, and the next follow.
        """
        parts = [df.withColumn(source, F.lit(k)) for k, df in enumerate((self.df, *others))]
        whole = reduce(lambda a, b: a.unionByName(b), parts)
        if error is not None:
            failed = {"_failed": ("max", F.coalesce(error.cast("int"), F.lit(0)))}
            found = running(whole, self.order, (*self.key, source), failed) if delay_error else running(whole, (source, *self.order), self.key, failed)
            whole = found.where("_failed = 0").drop("_failed")
        return self.with_df(whole, order=(source, *self.order))

    def merge_with(self, *others: DataFrame):
        """All rows; the mutual order of different sources is that of the order columns."""
        return self.with_df(reduce(lambda a, b: a.unionByName(b), others, self.df))

    def amb_with(self, *others: DataFrame, time: str):
        """All of the source whose first row is earliest (ties: the first named), for each key."""
        index = "_index"
        union = reduce(lambda a, b: a.unionByName(b), (df.withColumn(index, F.lit(k)) for k, df in enumerate((self.df, *others))))
        winner = union.groupBy(*self.key).agg(F.min_by(index, F.struct(time, index)).alias("_winner"))
        if self.key:
            joined = keyed_join(union, winner, self.key)
        else:
            joined = union.crossJoin(F.broadcast(winner))  # one row
        return self.with_df(joined.where("_index = _winner").drop(index, "_winner"))

    def zip_with(self, *others, place: str = "place"):
        """Row i with row i of each other sequence, as far as the shortest; others' clashing columns get a suffix _2, _3, ...

        Every input is numbered once and all are joined on key and place, however many there are.
        """
        out = numbered(self.df, self.order, self.key, place)
        for k, other in enumerate(others, 2):
            right = numbered(other.df, other.order, other.key, place)
            clash = [c for c in right.columns if c in out.columns and c not in (*self.key, place)]
            out = keyed_join(out, right.withColumnsRenamed({c: f"{c}_{k}" for c in clash}), [*self.key, place])
        return self.with_df(out, order=(place,))

    def zip_with_values(self, values: Sequence, name: str = "other", place: str = "place"):
        """Row i with the i-th of some driver-side values."""
        out = numbered(self.df, self.order, self.key, place)
        if not values:
            return self.with_df(out.withColumn(name, F.lit(None).cast("string")).where(F.lit(False)), order=(place,))
        listed = self.df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(values)], [place, name])
        return self.with_df(out.join(listed, place), order=(place,))

    def combine_latest(self, parts: dict[str, DataFrame]):
        """At each row of any source, the latest row of every source as a struct named after it, once all have one.

        The sources share key and order columns; this sequence's own table isn't one of them.
        """
        union = tagged(parts, self.positions, "arrived")
        found = running(union, self.order, self.key, {f"_{n}": ("last", F.col(n)) for n in parts})
        ready = reduce(lambda a, b: a & b, (F.col(f"_{n}").isNotNull() for n in parts))
        return self.with_df(found.where(ready).select(*self.positions, "arrived", *(F.col(f"_{n}").alias(n) for n in parts)))

    def with_latest_from(self, other: DataFrame, name: str = "latest"):
        """Each row with the other's latest row (a struct) before or at it; rows before the first are dropped. An as-of join."""
        union = tagged({"_main": self.df, "_other": other}, self.positions, "_source")
        # at equal order the other's row counts as earlier
        union = union.withColumn("_turn", F.when(F.col("_source") == "_other", 0).otherwise(1))
        found = running(union, (*self.order, "_turn"), self.key, {"_latest": ("last", F.col("_other"))})
        rows = found.where("_source = '_main' and _latest is not null")
        return self.with_df(rows.select("_main.*", F.col("_latest").alias(name)))

    def join_overlapping(self, other: DataFrame, span: tuple[str, str], other_span: tuple[str, str], how: str = "inner", on: Sequence[str] | None = None, grain: int | None = None) -> DataFrame:
        """Pairs of rows whose lifetimes [start, end) meet; a null end never comes."""
        return overlapping(self.df, other, list(self.key if on is None else on), span, other_span, how, grain)

    def group_join(self, other: DataFrame, span: tuple[str, str], other_span: tuple[str, str], value: Column, order: Sequence[str], name: str = "matches", grain: int | None = None) -> DataFrame:
        """Each row with the ordered list of the values of the other's overlapping rows; an empty list where there are none."""
        return grouped(self.df, other, list(self.key), span, other_span, value, order, name, grain)


def concat(*sequences):
    """One after another; no sequence at all is an error in Spark, where a schema is needed."""
    first, *rest = sequences
    return first.concat_with(*(s.df for s in rest)) if rest else first


def merge(*sequences):
    first, *rest = sequences
    return first.merge_with(*(s.df for s in rest))


def zip_all(*sequences):
    first, *rest = sequences
    return first.zip_with(*rest)
