"""Where rows leave Spark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import DataFrame, Row


class Sinks:
    def subscribe(self, on_next: Callable[[Row], None] | None = None) -> None:
        """Run; with a function, on the executors for each row."""
        self.df.foreach(on_next) if on_next else self.drain()

    def drain(self) -> None:
        """Evaluate every row and keep none."""
        self.df.write.format("noop").mode("overwrite").save()

    def _placed(self) -> DataFrame:
        return self.df.orderBy(*self.key, *self.order)

    def to_iterable(self, prefetch: bool = True) -> Iterator[Row]:
        """Rows in order, a partition at a time."""
        return self._placed().toLocalIterator(prefetchPartitions=prefetch)

    stream = to_iterable

    def first_row(self) -> DataFrame:
        """The first row as a table, by a top-1 and not a sort."""
        return self.df.orderBy(*self.order).limit(1)

    def last_row(self) -> DataFrame:
        return self.df.orderBy(*(self.df[c].desc() for c in self.order)).limit(1)

    def _in_time(self, action: Callable[[], object], seconds: float | None):
        """The action's result; a TimeoutError, and the end of its jobs, after so many seconds."""
        if seconds is None:
            return action()
        context, group = self.df.sparkSession.sparkContext, f"tidewise-{uuid.uuid4().hex}"

        def run():
            context.setJobGroup(group, "limited in time", interruptOnCancel=True)
            return action()

        pool = ThreadPoolExecutor(1)
        future = pool.submit(run)
        try:
            return future.result(seconds)
        except Late:
            context.cancelJobGroup(group)
            raise TimeoutError(f"no result within {seconds} s") from None
        finally:
            pool.shutdown(wait=False)

    def blocking_first(self, timeout: float | None = None) -> Row | None:
        return self._in_time(lambda: next(iter(self.first_row().collect()), None), timeout)

    def blocking_last(self, timeout: float | None = None) -> Row | None:
        return self._in_time(lambda: next(iter(self.last_row().collect()), None), timeout)

    def test(self, most: int = 100_000) -> Checked:
        """An assertion helper over the ordered rows, for tests; more than ``most`` rows are an error, not a cut."""
        return Checked(self, most)

    peek_last = blocking_last

    def to_future(self, default=None, strict: bool = True) -> Future:
        """The last row, or the default; without one an empty sequence is a LookupError (strict)."""

        def run():
            last = self.blocking_last()
            if last is None and default is None and strict:
                raise LookupError("the sequence is empty")
            return default if last is None else last

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(run)
        finally:
            pool.shutdown(wait=False)


class Checked:
    """Assertions on what a sequence delivers; each returns the helper, so that they chain."""

    def __init__(self, seq: Sinks, most: int):
        self.error: Exception | None = None
        self.rows: list[Row] = []
        try:
            self.rows = seq._placed().limit(most + 1).collect()
        except Exception as error:
            self.error = error
        if len(self.rows) > most:
            raise ValueError(f"more than {most} rows")

    def assert_values(self, column: str, *values) -> Checked:
        found = [r[column] for r in self.rows]
        assert found == list(values), f"{found} instead of {list(values)}"
        return self

    def assert_count(self, n: int) -> Checked:
        assert len(self.rows) == n, f"{len(self.rows)} rows instead of {n}"
        return self

    def assert_complete(self) -> Checked:
        assert self.error is None, f"failed: {self.error}"
        return self

    def assert_error(self, message: str = "") -> Checked:
        assert self.error is not None and message in str(self.error), f"no such error, but {self.error}"
        return self
