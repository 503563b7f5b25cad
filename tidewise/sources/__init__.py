"""Sources: constants, ranges, driver-side values, generators and clocks, as sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..seq import Seq

INT_MAX = 2**31 - 1


def just(spark: SparkSession, value, name: str = "value") -> Seq:
    if value is None:
        raise ValueError("a value is required")
    return Seq(spark.range(1).select(F.lit(0).cast("long").alias("ord"), F.lit(value).alias(name)), "ord")


def empty(spark: SparkSession, schema: str | StructType = "value int") -> Seq:
    return Seq(spark.createDataFrame([], schema).withColumn("ord", F.lit(0).cast("long")), "ord")


def never(kind: str = "long") -> Column:
    """The end of a span that doesn't end."""
    return F.lit(None).cast(kind)


def error(spark: SparkSession, message: str | Callable[[], str], schema: str = "value int") -> Seq:
    """Fails when an action asks for its rows."""
    text = message() if callable(message) else message
    kind = spark.createDataFrame([], schema)
    row = spark.range(1).select(F.col("id").alias("ord"), *(F.raise_error(F.lit(text)).cast(f.dataType).alias(f.name) for f in kind.schema))
    return Seq(row, "ord")


def range_(spark: SparkSession, start: int, count: int, name: str = "value") -> Seq:
    if count < 0:
        raise ValueError("count >= 0 required")
    if count and start + count - 1 > INT_MAX:
        raise ValueError("the range exceeds 32 bits")
    return Seq(spark.range(start, start + count).select((F.col("id") - start).alias("ord"), F.col("id").cast("int").alias(name)), "ord")


def from_array(spark: SparkSession, *values, name: str = "value") -> Seq:
    if any(v is None for v in values):
        raise ValueError("null element")
    if not values:
        return empty(spark, f"{name} string")
    return Seq(spark.range(1).select(F.posexplode(F.array(*(F.lit(v) for v in values))).alias("ord", name)).withColumn("ord", F.col("ord").cast("long")), "ord")


def from_iterable(spark: SparkSession, values: Iterable, schema: str = "value int") -> Seq:
    """Driver-side values (tuples for several columns), numbered in their order."""
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
    return Seq(spark.createDataFrame(rows, f"ord long, {schema}"), "ord")


def from_stream(spark: SparkSession, values: Iterator, schema: str = "value int") -> Seq:
    """As from_iterable; an iterator is read once."""
    return from_iterable(spark, values, schema)


def from_callable(spark: SparkSession, function: Callable[[], object], kind: str = "int", name: str = "value") -> Seq:
    """One value, computed on an executor when an action asks for it; null is an error."""
    call = F.udf(function, kind).asNondeterministic()
    found = spark.range(1).select(F.col("id").alias("ord"), call().alias(name))
    checked = F.when(F.col(name).isNull(), F.raise_error(F.lit("the callable returned null"))).otherwise(F.col(name))
    return Seq(found.select("ord", checked.alias(name)), "ord")


def from_future(spark: SparkSession, future, name: str = "value") -> Seq:
    """Waits on the driver; the future isn't cancelled."""
    return just(spark, future.result(), name)


def characters(text: Column, df: DataFrame, order: tuple[str, ...], key: tuple[str, ...] = (), name: str = "code") -> Seq:
    """One row a character, as its code point (characters outside the basic plane are one row)."""
    keep = [*key, *(c for c in order if c not in key)]
    chars = df.select(*keep, F.posexplode(F.split(text, "")).alias("pos", "_c")).where("_c <> ''")
    return Seq(chars.select(*keep, "pos", F.ascii("_c").alias(name)), (*order, "pos"), key)


def defer(supplier: Callable[[], Seq]) -> Callable[[], Seq]:
    """A source built anew for each use."""
    return supplier


@contextmanager
def using(resource: Callable[[], object], factory: Callable[[object], Seq], dispose: Callable[[object], None], eager: bool = True, on_complete: Callable[[], None] | None = None) -> Iterator[Seq]:
    """A sequence over a resource that is disposed of afterwards, also if the factory fails: before the completion is told (eager) or after it."""
    held = resource()
    done = False
    try:
        yield factory(held)
        if on_complete and not eager:
            on_complete()
        done = True
    finally:
        dispose(held)
    if done and on_complete and eager:
        on_complete()


def generate(spark: SparkSession, state, step: Callable[[object], tuple | None], most: int | None = None, schema: str = "value int", consume: Callable[[object], None] | None = None) -> Seq:
    """An unfold on the driver: step(state) gives (value, state) or None to end. See generate_sql for executors.

    most: an error beyond so many rows (None: no such limit). consume: told the last state at the end, also if a step fails.
    """
    values = []
    try:
        while (made := step(state)) is not None:
            if most is not None and len(values) >= most:
                raise ValueError(f"more than {most} rows were generated")
            value, state = made
            values.append(value)
    finally:
        if consume:
            consume(state)
    return from_iterable(spark, values, schema)


def generate_sql(spark: SparkSession, first: str, step: str, more: str, name: str = "value") -> Seq:
    """An unfold whose step is SQL over the value so far, as a recursive query."""
    return Seq(spark.sql(f"WITH RECURSIVE g(ord, {name}) AS (SELECT 0L, {first} UNION ALL SELECT ord + 1, {step} FROM g WHERE {more}) SELECT * FROM g"), "ord")


def timer(spark: SparkSession, start: int, delay: int) -> Seq:
    """A single 0 at start + delay."""
    return Seq(spark.range(1).select(F.lit(start + delay).cast("long").alias("ts"), F.lit(0).cast("long").alias("value")), "ts")


def interval(spark: SparkSession, start: int, end: int, period: int, delay: int | None = None) -> Seq:
    """0, 1, 2, ... at start + delay and every period after, to the end inclusive: a tick table."""
    if period < 1:
        raise ValueError("period must be positive")
    first = start + (period if delay is None else delay)
    count = max(0, (end - first) // period + 1)
    return Seq(spark.range(count).select((F.col("id") * period + first).alias("ts"), F.col("id").alias("value")), "ts")


def interval_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """The unbounded clock, as a stream."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def wrap(df: DataFrame, order: str | tuple[str, ...], key: str | tuple[str, ...] = ()) -> Seq:
    return Seq(df, order, key)


from_ = wrap
