"""Rate operators on event time: a duration is a number in the unit of the time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import keyed_join, neighbour, numbered, running, stepped
from .windows import ID


class Timed:
    def sample(self, ticks: DataFrame, time: str, tick_time: str):
        """At each tick the latest row since the tick before, if any; what follows the last tick is dropped."""
        rows = self._ticked(ticks, time, tick_time, closed=True)
        latest = F.row_number().over(Window.partitionBy(*self.key, ID).orderBy(*(F.desc(c) for c in self.order)))
        return self.with_df(rows.where("_closed").withColumn("_n", latest).where("_n = 1").drop("_n", "_closed", ID))

    throttle_last = sample

    def throttle_first(self, time: str, period: Column | int):
        """A row, then none until its period is over; the first row at or after that is next. Constant state, whatever a key's length."""

        def start():
            due = 0

            def step(begins: list, times: list, ends: list) -> list:
                nonlocal due
                out = []
                for begin, at, end in zip(begins, times, ends):
                    open_ = begin or at >= due
                    if open_:
                        due = end
                    out.append(open_)
                return out

            return step

        found = stepped(self.df, self.order, self.key, {"t": F.col(time), "until": F.col(time) + period}, start, "_open", "boolean")
        return self.with_df(found.where("_open").drop("_open"))

    def throttle_timeout(self, time: str, period: Column | int):
        """Rows after which none comes until their period is over; the last row always."""
        found = neighbour(self.df, self.order, self.key, {"_next": F.col(time)}, after=True)
        return self.with_df(found.where(F.col("_next").isNull() | (F.col("_next") > F.col(time) + period)).drop("_next"))

    debounce = throttle_timeout

    def _late(self, time: str, period: Column | int, first: Column | None) -> DataFrame:
        """With _late: whether the row, or one before it, came more than its predecessor's period after it."""
        found = neighbour(self.df, self.order, self.key, {"_due": F.col(time) + period})
        due = F.coalesce("_due", first) if first is not None else F.col("_due")
        return running(found.withColumn("_over", (F.col(time) > due).cast("int")), self.order, self.key, {"_late": ("max", F.coalesce("_over", F.lit(0)))}).drop("_due", "_over")

    def timeout(self, time: str, period: Column | int, first: Column | None = None, strict: bool = False):
        """Rows up to the first gap longer than the period; strict: such a gap fails the job instead. first: when the first row is due."""
        found = self._late(time, period, first)
        keep = F.when(F.col("_late") == 1, F.raise_error(F.lit("timeout"))).otherwise(F.lit(True)) if strict else F.col("_late") == 0
        return self.with_df(found.where(keep).drop("_late"))

    def timeout_fallback(self, time: str, period: Column | int, fallback: DataFrame, first: Column | None = None, source: str = "source_index"):
        """As timeout, and where there was such a gap the fallback's rows of that key follow."""
        found = self._late(time, period, first)
        late = found.where("_late = 1")
        kept = found.where("_late = 0").drop("_late").withColumn(source, F.lit(0))
        if self.key:
            instead = keyed_join(fallback, late.select(*self.key).distinct(), self.key, "left_semi")
        else:
            instead = fallback.crossJoin(F.broadcast(late.agg((F.count("*") > 0).alias("_any")))).where("_any").drop("_any")  # one row
        return self.with_df(kept.unionByName(instead.withColumn(source, F.lit(1))), order=(source, *self.order))

    def delay_subscription(self, other: DataFrame | None = None, time: str | None = None, other_time: str | None = None):
        """A cold sequence is the same whenever it starts; on event time rows before the other's first row are missed."""
        return self if other is None else self.skip_until_other(other, time, other_time)

    # load shedding

    def on_backpressure_drop(self, ticks: DataFrame, time: str, tick_time: str, n: int):
        """Of the rows between two ticks (a consumer's turns) the first n; the rest is dropped."""
        rows = self._ticked(ticks, time, tick_time)
        place = numbered(rows, self.order, [*self.key, ID], "_n")
        return self.with_df(place.where(F.col("_n") < n).drop("_n", ID))

    def on_backpressure_latest(self, ticks: DataFrame, time: str, tick_time: str):
        """Of the rows between two ticks the last; also of those after the last tick."""
        rows = self._ticked(ticks, time, tick_time)
        latest = F.row_number().over(Window.partitionBy(*self.key, ID).orderBy(*(F.desc(c) for c in self.order)))
        return self.with_df(rows.withColumn("_n", latest).where("_n = 1").drop("_n", ID))
