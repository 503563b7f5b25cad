"""The registry, and the inputs that most queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..seq import Seq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: The events with microseconds since 1970 and the whole part of the value, as SQL.
EV = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS v FROM events)"


def query(sql: str | None = None):
    """Register a function under its name, with its twin for DuckDB."""

    def put(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("us"), F.floor("value").cast("long").alias("v"))


def by_user(spark: SparkSession, sf_dir: str) -> Seq:
    return Seq(events(spark, sf_dir), "event_id", "user_id")


def whole(spark: SparkSession, sf_dir: str) -> Seq:
    return Seq(events(spark, sf_dir), "event_id")


def kind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == name)


def listed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")
