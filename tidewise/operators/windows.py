"""Groups, buffers and windows.

A window is a column ``window_id`` on the rows (rows in several windows repeat); a buffer gathers a window's values
into an ordered list. Ticks are rows of another table with the key columns and a time; a tick at the time
of a row comes first. The choice of plan (no explosion where windows don't overlap) is made from the sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered_values
from ..plans.order import keyed_join, numbered, overlapping, running, stepped

ID = "window_id"


class Windows:
    def group_by(self, *keys: str, strict: bool = False, **values: Column):
        """The sequences of each key: rows keep their order inside a group; strict: a null key or value fails the job."""
        df = self.df.withColumns(values) if values else self.df
        if strict:
            test = F.lit(True)
            for c in (*keys, *values):
                test = test & F.col(c).isNotNull()
            df = df.where(F.when(test, True).otherwise(F.raise_error(F.lit("group_by: null key or value"))))
        return self.with_df(df, key=(*self.key, *keys))

    # by count

    def window(self, size: int, skip: int | None = None):
        """Windows of ``size`` rows, one beginning every ``skip`` rows (``size`` by default)."""
        skip = size if skip is None else skip
        if size < 1 or skip < 1:
            raise ValueError("size and skip must be positive")
        rows, n = numbered(self.df, self.order, self.key, "_n"), F.col("_n")
        if skip >= size:
            rows = rows.where(n % skip < size) if skip > size else rows
            rows = rows.withColumn(ID, F.floor(n / skip).cast("long"))
        else:
            first = F.greatest(F.lit(0), F.ceil((n - (size - 1)) / skip)).cast("long")
            rows = rows.withColumn(ID, F.explode(F.sequence(first, F.floor(n / skip).cast("long"))))
        return self.with_df(rows.drop("_n"), key=(*self.key, ID))

    def buffer(self, size: int, skip: int | None = None, value: Column | None = None, name: str = "buffer") -> DataFrame:
        return self.window(size, skip).gathered(value, name)

    def gathered(self, value: Column | None = None, name: str = "buffer") -> DataFrame:
        """The ordered list of values of each key (window)."""
        value = F.struct(*self.values) if value is None else value
        return self.df.groupBy(*self.key).agg(ordered_values(value, self.order).alias(name))

    # by ticks

    def _ticked(self, ticks: DataFrame, time: str, tick_time: str, closed: bool = False) -> DataFrame:
        """Rows with window_id, the number of ticks of their key at or before them, and on demand _closed, whether one comes after them."""
        shared = [*self.key]
        row = F.struct(*self.df.columns)
        kind = self.df.select(row.alias("r")).schema["r"].dataType
        main = self.df.select(*shared, F.col(time).alias("_t"), F.lit(1).alias("_turn"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(self.order)), row.alias("_row"), F.lit(0).alias("_tick"))
        types = dict(self.df.dtypes)
        tick = ticks.select(*shared, F.col(tick_time).cast(types[time]).alias("_t"), F.lit(0).alias("_turn"), *(F.lit(None).cast(types[c]).alias(f"_o{k}") for k, c in enumerate(self.order)), F.lit(None).cast(kind).alias("_row"), F.lit(1).alias("_tick"))
        order = ["_t", "_turn", *(f"_o{k}" for k in range(len(self.order)))]
        counted = running(main.unionByName(tick), order, self.key, {ID: ("sum", F.col("_tick"))})
        if closed:
            counted = running(counted, order, self.key, {"_closed": ("max", F.col("_tick"))}, reverse=True)
        return counted.where("_tick = 0").select("_row.*", F.col(ID).cast("long").alias(ID), *([(F.col("_closed") == 1).alias("_closed")] if closed else []))

    def window_boundary(self, ticks: DataFrame, time: str, tick_time: str):
        """A tick closes the open window and opens the next; the first is open from the start."""
        return self.with_df(self._ticked(ticks, time, tick_time), key=(*self.key, ID))

    def _all_windows(self, ticks: DataFrame, last: bool) -> DataFrame:
        """Key and window_id of all windows, empty ones included: 0 to the number of ticks (the last only on demand)."""
        count = ticks.groupBy(*self.key).agg(F.count("*").alias("_k"))
        if self.key:
            count = keyed_join(self.df.select(*self.key).union(ticks.select(*self.key)).distinct(), count, self.key, "left")
        to = F.coalesce("_k", F.lit(0)) - (0 if last else 1)
        ids = F.when(to >= 0, F.sequence(F.lit(0).cast("long"), to.cast("long")))
        return count.select(*self.key, F.explode(ids).alias(ID))

    def windows_boundary(self, ticks: DataFrame, time: str, tick_time: str, value: Column | None = None, name: str = "buffer") -> DataFrame:
        """Every boundary window as a list, empty ones and the last included."""
        return self._filled(self.window_boundary(ticks, time, tick_time).gathered(value, name), self._all_windows(ticks, True), name)

    def buffer_boundary(self, ticks: DataFrame, time: str, tick_time: str, value: Column | None = None, name: str = "buffer") -> DataFrame:
        """A list for each tick (maybe empty), and for what follows the last tick if there is anything."""
        found = self.window_boundary(ticks, time, tick_time).gathered(value, name)
        closed = self._all_windows(ticks, False)
        tail = keyed_join(found, closed, [*self.key, ID], "left_anti")
        return self._filled(found, closed, name).unionByName(tail)

    def _filled(self, found: DataFrame, every: DataFrame, name: str) -> DataFrame:
        kind = found.schema[name].dataType
        joined = keyed_join(every, found, [*self.key, ID], "left")
        return joined.select(*self.key, ID, F.coalesce(name, F.array().cast(kind)).alias(name))

    def window_boundary_size(self, ticks: DataFrame, time: str, tick_time: str, size: int):
        """Windows closed by a tick or by ``size`` rows, those with rows; columns window_id and part (within the tick's stretch)."""
        inner = self.with_df(self._ticked(ticks, time, tick_time), key=(*self.key, ID))
        rows = numbered(inner.df, self.order, inner.key, "_n").withColumn("part", F.floor(F.col("_n") / size).cast("long")).drop("_n")
        return self.with_df(rows, key=(*self.key, ID, "part"))

    def windows_boundary_size(self, ticks: DataFrame, time: str, tick_time: str, size: int, value: Column | None = None, name: str = "buffer") -> DataFrame:
        """With the empty windows: a stretch of n rows between ticks gives floor(n / size) + 1 windows."""
        found = self.window_boundary_size(ticks, time, tick_time, size).gathered(value, name)
        kind = found.schema[name].dataType
        full = found.groupBy(*self.key, ID).agg(F.sum(F.size(name)).alias("_n"))
        every = keyed_join(self._all_windows(ticks, True), full, [*self.key, ID], "left")
        parts = every.select(*self.key, ID, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.coalesce("_n", F.lit(0)) / size).cast("long"))).alias("part"))
        return keyed_join(parts, found, [*self.key, ID, "part"], "left").select(*self.key, ID, "part", F.coalesce(name, F.array().cast(kind)).alias(name))

    def buffer_boundary_size(self, ticks: DataFrame, time: str, tick_time: str, size: int, value: Column | None = None, name: str = "buffer") -> DataFrame:
        """Lists closed by a tick or by size; empty ones are skipped but for the last, which comes even if empty."""
        found = self.window_boundary_size(ticks, time, tick_time, size).gathered(value, name)
        kind = found.schema[name].dataType
        count = self._all_windows(ticks, True).groupBy(*self.key).agg(F.max(ID).alias(ID))
        rows = found.groupBy(*self.key, ID).agg(F.sum(F.size(name)).alias("_n"))
        last = keyed_join(count, rows, [*self.key, ID], "left").where(F.coalesce("_n", F.lit(0)) % size == 0)
        empty = last.select(*self.key, ID, F.floor(F.coalesce("_n", F.lit(0)) / size).cast("long").alias("part"), F.array().cast(kind).alias(name))
        return found.unionByName(empty)

    # by start and end

    def window_start_end(self, spans: DataFrame, time: str, start: str, end: str, span_id: str, grain: int | None = None):
        """Windows opened by the rows of ``spans`` and closed at their own end (null: never); they may overlap."""
        point = self.df.withColumn("_until", F.col(time) + 1)
        found = overlapping(point, spans.select(*self.key, F.col(span_id).alias(ID), F.col(start).alias("_start"), F.col(end).alias("_end")), list(self.key), (time, "_until"), ("_start", "_end"), grain=grain)
        return self.with_df(found.drop("_until", "_start", "_end"), key=(*self.key, ID))

    window_begin_end = window_start_end

    def buffer_start_end(self, spans: DataFrame, time: str, start: str, end: str, span_id: str, value: Column | None = None, name: str = "buffer", grain: int | None = None) -> DataFrame:
        """The list of each span's rows, in order; empty where there are none."""
        found = self.window_start_end(spans, time, start, end, span_id, grain).gathered(value, name)
        return self._filled(found, spans.select(*self.key, F.col(span_id).alias(ID)), name)

    def window_batch(self, time: str, period: int, size: int, opened: Column | None = None):
        """Windows closed by size or by a period that begins anew when the window before closes.

        opened: when the first window opens (the key's first time by default). A period that ends on an empty window begins
        again. Constant state, whatever a key's length.
        """

        def start():
            at_open, n, window = 0, 0, -1

            def step(begins: list, times: list, firsts: list) -> list:
                nonlocal at_open, n, window
                out = []
                for begin, at, first in zip(begins, times, firsts):
                    if begin:
                        at_open, n, window = first, 0, -1
                    late = at >= at_open + period
                    n = 1 if late else n + 1
                    if n == 1:
                        window += 1
                    if n == size:
                        at_open, n = at, 0
                    elif late:
                        at_open += (at - at_open) // period * period
                    out.append(window)
                return out

            return step

        anchor = F.min(F.col(time) if opened is None else opened).over(Window.partitionBy(*self.key))
        found = stepped(self.df.withColumn("_opened", anchor), self.order, self.key, {"t": F.col(time), "o": F.col("_opened")}, start, ID)
        return self.with_df(found.drop("_opened"), key=(*self.key, ID))


def summarised(windows, **columns: Column) -> DataFrame:
    """Aggregates of each window."""
    return windows.df.groupBy(*windows.key).agg(*(c.alias(k) for k, c in columns.items()))


def grouped_windows(windows, keys: Sequence[str]) -> DataFrame:
    return windows.df.groupBy(*keys)
