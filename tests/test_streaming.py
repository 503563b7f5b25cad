"""Streams over files give what batch gives, but for windows the watermark hasn't closed."""

import pytest
from pyspark.sql import functions as F

from tidewise import Seq, streaming

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def rows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    return events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("v")).orderBy("event_id")


@pytest.fixture(scope="module")
def stream(spark, rows, tmp_path_factory):
    """Three files in order of time, read one a micro-batch."""
    folder = tmp_path_factory.mktemp("events")
    cuts = [0, 300, 700, 10_000]
    for a, b in zip(cuts, cuts[1:]):
        rows.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1).write.mode("append").parquet(str(folder / "all"))
    return lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "all"))


def found(df, *columns):
    return sorted(tuple(r) for r in streaming.run_available(df).select(*columns).collect())


def test_groups_and_samples(spark, rows, stream):
    got = found(streaming.group_counts(stream(), "ts", "2 hours", "1 day", ["event_type"]), "start", "event_type", "n")
    want = {(r["s"], r["event_type"]): r["n"] for r in rows.groupBy(F.window("ts", "1 day").start.alias("s"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[(s, k)] == n for s, k, n in got)
    last = max(s for s, _ in want)
    assert {(s, k) for s, k, _ in got} >= {(s, k) for s, k in want if s < last and (last - s).days > 1}
    lists = found(streaming.buffers(stream(), "ts", "2 hours", "1 day", ["event_type"], F.col("event_id"), ["event_id"]), "buffer")
    assert all(x[0] == sorted(x[0]) for x in lists)
    tops = found(streaming.latest_per_tick(stream(), "ts", "2 hours", "1 day", ["user_id"], "event_id"), "start", "user_id", "event_id")
    best = {(r["s"], r["user_id"]): r["m"] for r in rows.groupBy(F.window("ts", "1 day").start.alias("s"), "user_id").agg(F.max("event_id").alias("m")).collect()}
    assert tops and all(best[(s, u)] == m for s, u, m in tops)


def test_distinct_and_join(spark, rows, stream):
    assert len(found(streaming.distinct(stream(), "ts", "100 days", ["user_id"]), "user_id")) == rows.select("user_id").distinct().count()
    pick = lambda kind, p: stream().where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{p}_user"), F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"))
    got = found(streaming.overlap_join(pick("click", "l"), pick("purchase", "r"), ("l_ts", "r_ts"), ("100 days", "100 days"), ("1 day", "2 days"), F.col("l_user") == F.col("r_user")), "l_id", "r_id")
    us = rows.withColumn("us", F.unix_micros("ts"))
    side = lambda kind, p, h: us.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("us").alias(f"{p}_a"), (F.col("us") + h * HOUR).alias(f"{p}_z"))
    want = Seq(side("click", "l", 24), "l_id", "user_id").join_overlapping(side("purchase", "r", 48), ("l_a", "l_z"), ("r_a", "r_z")).select("l_id", "r_id")
    assert got == sorted(tuple(r) for r in want.collect())


def test_stateful_operators_equal_batch(spark, rows, stream):
    us = Seq(rows.withColumn("us", F.unix_micros("ts")), "event_id", "user_id")
    got = found(streaming.throttle_first(stream(), ["user_id"], "ts", 12 * HOUR), "event_id")
    assert got == sorted(tuple(r) for r in us.throttle_first("us", 12 * HOUR).df.select("event_id").collect())
    got = found(streaming.window_batch(stream(), ["user_id"], "ts", 168 * HOUR, 4), "event_id", "window_id")
    assert got == sorted(tuple(r) for r in us.window_batch("us", 168 * HOUR, 4).df.select("event_id", "window_id").collect())
    parts = {n: rows.where(F.col("event_type") == n).select("user_id", "event_id", "ts", "v") for n in ("click", "purchase")}
    want = Seq(parts["click"], "event_id", "user_id").combine_latest(parts).df.select("user_id", F.col("click.v"), F.col("purchase.v"))
    got = found(streaming.combine_latest(stream(), ["user_id"], "ts", "event_type", "v", ["click", "purchase"]), "user_id", "click", "purchase")
    assert got == sorted(tuple(r) for r in want.collect())
    want = Seq(parts["click"], "event_id", "user_id").with_latest_from(parts["purchase"]).df.select("user_id", "v", F.col("latest.v"))
    got = found(streaming.with_latest_from(stream(), ["user_id"], "ts", "event_type", "v", "click", "purchase"), "user_id", "click", "purchase")
    assert got == sorted(tuple(r) for r in want.collect())
