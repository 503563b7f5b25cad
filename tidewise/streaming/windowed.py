"""Operators that Spark's built-in streaming state covers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_counts(stream: DataFrame, time: str, delay: str, size: str, keys: Sequence[str], slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of each key and time window, once the watermark has passed its end."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    columns = [c.alias(k) for k, c in aggregates.items()] or [F.count("*").alias("n")]
    found = stream.withWatermark(time, delay).groupBy(window.alias("w"), *keys).agg(*columns)
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *(c for c in found.columns if c not in ("w", *keys)))


def buffers(stream: DataFrame, time: str, delay: str, size: str, keys: Sequence[str], value: Column, order: Sequence[str]) -> DataFrame:
    """The ordered list of values of each key and window."""
    item = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), value.alias("v"))
    found = group_counts(stream, time, delay, size, keys, buffer=F.sort_array(F.collect_list(item)))
    return found.withColumn("buffer", F.transform("buffer", lambda s: s["v"]))


def latest_per_tick(stream: DataFrame, time: str, delay: str, period: str, keys: Sequence[str], order: str) -> DataFrame:
    """Sampling: the last row of each key and period."""
    rest = [c for c in stream.columns if c not in keys]
    found = group_counts(stream, time, delay, period, keys, row=F.max_by(F.struct(*rest), F.col(order)))
    return found.select("start", *keys, "row.*")


def distinct(stream: DataFrame, time: str, delay: str, by: Sequence[str]) -> DataFrame:
    """The first row of each combination within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(by))


def overlap_join(left: DataFrame, right: DataFrame, times: tuple[str, str], delays: tuple[str, str], lasts: tuple[str, str], on: Column | None = None) -> DataFrame:
    """Pairs of rows whose lifetimes meet: each lasts the given interval; both sides are watermarked, so state is bounded."""
    (lt, rt), (ll, rl) = times, lasts
    meets = (F.col(lt) < F.col(rt) + F.expr(f"interval {rl}")) & (F.col(rt) < F.col(lt) + F.expr(f"interval {ll}"))
    return left.withWatermark(lt, delays[0]).join(right.withWatermark(rt, delays[1]), meets if on is None else meets & on)


def run_available(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote; for tests and backfills."""
    name = f"stream_{uuid.uuid4().hex}"
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    # a machine-local folder only where the session names no shared one, as in tests
    place = checkpoint or (f"{shared.rstrip('/')}/{name}" if shared else tempfile.mkdtemp(prefix="tidewise-stream-"))
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
