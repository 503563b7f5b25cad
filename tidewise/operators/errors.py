"""Errors, retries and repetition.

A failing action fails as a whole, so what came before an error can only be kept where the error is a condition on rows:
``on_error_*`` take that condition. Retries and companions are driver-side control flow around an action.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import keyed_join, running


class Errors:
    def _failed(self, error: Column) -> DataFrame:
        return running(self.df, self.order, self.key, {"_failed": ("max", F.coalesce(error.cast("int"), F.lit(0)))})

    def on_error_resume(self, error: Column, fallback: DataFrame, source: str = "source_index"):
        """Rows before the first error, then (for keys that had one) the fallback's rows."""
        found = self._failed(error)
        failed = found.where("_failed = 1")
        if self.key:
            instead = keyed_join(fallback, failed.select(*self.key).distinct(), self.key, "left_semi")
        else:
            instead = fallback.crossJoin(F.broadcast(failed.agg((F.count("*") > 0).alias("_any")))).where("_any").drop("_any")  # one row
        kept = found.where("_failed = 0").drop("_failed").withColumn(source, F.lit(0))
        return self.with_df(kept.unionByName(instead.withColumn(source, F.lit(1))), order=(source, *self.order))

    def on_error_return(self, error: Column, **values):
        """Rows before the first error, then one row of the given values at the error's place (other columns null)."""
        found = running(self._failed(error), self.order, self.key, {"_before": ("max", F.col("_failed"))}, exclusive=True)
        at = found.where("_failed = 1 and coalesce(_before, 0) = 0")
        given = at.select(*(F.lit(values[f.name]).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) if f.name in self.positions else F.lit(None).cast(f.dataType).alias(f.name) for f in self.df.schema))
        return self.with_df(found.where("_failed = 0").select(*self.df.columns).unionByName(given))

    def repeat(self, n: int, copy: str = "copy"):
        """n copies one after another; none gives an empty sequence."""
        if n < 0:
            raise ValueError("n >= 0 required")
        times = F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")) if n else F.array().cast("array<bigint>")
        return self.with_df(self.df.withColumn(copy, F.explode(times)), order=(copy, *self.order))

    def repeat_while(self, more: Callable[[], bool], copy: str = "copy"):
        """A copy, and another as long as the driver-side test says so."""
        n = 1
        while more():
            n += 1
        return self.repeat(n, copy)

    def repeat_when(self, companion: Callable[[Iterable[int]], Iterable], copy: str = "copy"):
        """A copy, and one more for each item that the companion makes of the stream of row counts."""
        count = self.df.count()

        def counts():
            while True:
                yield count

        return self.repeat(1 + sum(1 for _ in companion(counts())), copy)


def retry(action: Callable[[], object], n: int | None = None, when: Callable[[Exception], bool] | None = None):
    """Run an action, n more times if it fails (None: as often as ``when`` allows). Spark's jobs are whole or nothing, so nothing is emitted twice."""
    attempt = 0
    while True:
        try:
            return action()
        except Exception as error:
            if (n is not None and attempt >= n) or (when is not None and not when(error)) or (n is None and when is None and attempt >= 1_000_000):
                raise
            attempt += 1


def retry_when(action: Callable[[], object], policy: Callable[[int, Exception], float | None]):
    """Run an action; after each failure the policy names the seconds to wait before the next attempt, or None to give up."""
    attempt = 0
    while True:
        try:
            return action()
        except Exception as error:
            pause = policy(attempt, error)
            if pause is None:
                raise
            time.sleep(pause)
            attempt += 1
