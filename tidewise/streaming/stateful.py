"""Operators with their own state, by ``applyInPandasWithState``: one state a key, batches of rows as pandas frames.

Rows of a key are sorted by time inside a micro-batch; across micro-batches they are taken as they come, so sources should
be ordered by key and time up to the batches' borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def _stateful(stream: DataFrame, keys: list[str], function, out: str, state: str) -> DataFrame:
    return stream.groupBy(*keys).applyInPandasWithState(function, out, state, "append", GroupStateTimeout.NoTimeout)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def throttle_first(stream: DataFrame, keys: list[str], time: str, period_us: int) -> DataFrame:
    """A row, then none of its key until ``period_us`` microseconds have passed."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        until = state.get[0] if state.exists else None
        kept = []
        for place, at in enumerate(_micros(rows[time])):
            if until is None or at >= until:
                kept.append(place)
                until = int(at) + period_us
        if until is not None:
            state.update((until,))
        yield rows.iloc[kept]

    return _stateful(stream, keys, run, _schema(stream), "until long")


def window_batch(stream: DataFrame, keys: list[str], time: str, period_us: int, size: int) -> DataFrame:
    """Rows with window_id: windows close by size, or by a period that begins anew when the window before closes."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        times = _micros(rows[time]).tolist()
        opened, n, window = state.get if state.exists else (times[0], 0, -1)
        ids = []
        for at in times:
            late = at >= opened + period_us
            n = 1 if late else n + 1
            window += n == 1
            if n == size:
                opened, n = at, 0
            elif late:
                opened += (at - opened) // period_us * period_us
            ids.append(window)
        state.update((int(opened), int(n), int(window)))
        yield rows.assign(window_id=ids)

    return _stateful(stream, keys, run, f"{_schema(stream)}, window_id long", "opened long, n long, window long")


def _latest(stream: DataFrame, keys: list[str], time: str, source: str, value: str, names: list[str], driver: str | None) -> DataFrame:
    kind = dict(stream.dtypes)[value]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        rows = rows.assign(_turn=(rows[source] == driver).astype(int)).sort_values([time, "_turn"], kind="stable")
        latest = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
        out = []
        for at, name, item in zip(rows[time], rows[source], rows[value]):
            if name not in latest:
                continue
            latest[name] = item
            if all(v is not None for v in latest.values()) and driver in (None, name):
                out.append((*key, at, *(latest[n] for n in names)))
        state.update(tuple(latest[n] for n in names))
        yield pd.DataFrame(out, columns=[*keys, time, *names])

    types = dict(stream.dtypes)
    out = ", ".join(f"`{c}` {types[c]}" for c in (*keys, time)) + "".join(f", `{n}` {kind}" for n in names)
    return _stateful(stream, keys, run, out, ", ".join(f"`{n}` {kind}" for n in names))


def combine_latest(stream: DataFrame, keys: list[str], time: str, source: str, value: str, names: list[str]) -> DataFrame:
    """A tagged stream (``source`` names the sequence): at each row the latest value of every named source, once all have one."""
    return _latest(stream, keys, time, source, value, names, None)


def with_latest_from(stream: DataFrame, keys: list[str], time: str, source: str, value: str, main: str, other: str) -> DataFrame:
    """A tagged stream: at each row of ``main`` the latest of ``other``; rows before its first are dropped."""
    return _latest(stream, keys, time, source, value, [main, other], main)


