"""One source for several consumers: sharing, replay and last values."""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Multicast:
    def publish_select(self, selector: Callable):
        """Apply a function that uses the sequence several times; Spark reuses its exchanges, so no storage is needed."""
        return selector(self)

    def publish(self) -> Connectable:
        """A shared, stored copy that several consumers read; nothing runs before ``connect``."""
        return Connectable(self)

    def process(self, processor: Callable[[DataFrame], DataFrame] = lambda df: df, selector: Callable | None = None):
        """Multicast through a processor (direct: all rows; replay_last(n); async_last): a connectable, or the selector's result."""
        shared = self.with_df(processor(self.df))
        return shared.publish() if selector is None else selector(shared)

    def replay_last(self, n: int):
        """What a late consumer of a replay of bounded size sees: the last n rows."""
        return self.take_last(n)

    def replay_all(self):
        return self.with_df(self.df.select("*"))

    def async_last(self):
        """Only the very last row."""
        return self.take_last(1)


class Connectable:
    """A sequence stored on connect and shared from then on. Consumers count themselves in and out."""

    def __init__(self, source, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.source, self.level, self.connected = source, level, False
        self._consumers, self._lock = 0, Lock()

    def connect(self):
        """Store the source (lazily, at the first action); returns a function that disconnects."""
        with self._lock:
            if not self.connected:
                self.source.df.persist(self.level)
                self.connected = True
        return self.disconnect

    def disconnect(self) -> None:
        with self._lock:
            if self.connected:
                self.source.df.unpersist()
                self.connected = False

    def subscribe(self):
        return self.source

    def auto_connect(self, consumers: int = 1, on_connect: Callable[[Callable], None] = lambda stop: None) -> Callable:
        """A function that gives the sequence to each consumer and connects at the n-th (0: now)."""
        if consumers == 0:
            on_connect(self.connect())

        def arrive():
            with self._lock:
                self._consumers += 1
                due = self._consumers == consumers
            if due:
                on_connect(self.connect())
            return self.source

        return arrive

    def ref_count(self, consumers: int = 1) -> RefCount:
        """A context manager for each consumer: connected at the n-th, disconnected when the last leaves."""
        return RefCount(self, consumers)


class RefCount:
    def __init__(self, shared: Connectable, consumers: int):
        self.shared, self.consumers, self.inside = shared, consumers, 0

    def __enter__(self):
        self.inside += 1
        if self.inside >= self.consumers:
            self.shared.connect()
        return self.shared.source

    def __exit__(self, *_):
        self.inside -= 1
        if self.inside == 0:
            self.shared.disconnect()
