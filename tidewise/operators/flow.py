"""Taps, and operators that Spark's runtime makes unnecessary (kept so that chains carry over)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Observation


class Flow:
    def do_on_next(self, observation: Observation | str, *metrics: Column):
        """Metrics gathered while the rows pass, read from the observation after an action."""
        return self.with_df(self.df.observe(observation, *metrics))

    observe = do_on_next

    def observe_on(self, partitions: int | None = None):
        """A stage boundary: rows are dealt anew."""
        return self.with_df(self.df.repartition(partitions) if partitions else self.df)

    def subscribe_on(self, pool: str | None = None):
        """Actions from this thread run in a scheduler pool."""
        if pool:
            self.df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        return self

    def on_terminate_detach(self):
        return self

    def await_on_subscribe(self):
        return self

    def on_assembly(self):
        """Spark's errors name the place of the call already."""
        return self


def tapped(action: Callable[[], object], on_subscribe: Callable = lambda: None, on_error: Callable = lambda e: None, on_complete: Callable = lambda: None, after_terminate: Callable = lambda: None):
    """Run an action with taps on its life; a tap on completion that fails makes the action fail."""
    on_subscribe()
    try:
        try:
            out = action()
        except Exception as error:
            on_error(error)
            raise
        on_complete()
        return out
    finally:
        after_terminate()
