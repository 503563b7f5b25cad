"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source gets words in proportion to its weight, but at most ``epochs`` times what it has; the excess of clamped
sources is shared among the others by weight until none is above its cap. With the sources sorted by cap a weight, the
clamped ones are a prefix. The level that a prefix leaves to the rest rises while its last source is rightly clamped and falls
afterwards, so the water level is the largest of them: running sums over the source table, no loop.

A source's target over its size is the number of repetitions its documents get: the whole part for every document, the
fractional part as one more repetition of documents in a seeded random order until the words fit. The order is by
a hash of the id, cut into SLICES; slices wholly inside the fraction are taken, and in the slice where it ends a document is
taken with the probability that is left (a lone document, if more than half of it fits). The error is under one slice, a
2048th of the source, or half a document.

Defined results: null text has size 0 and is never short of its repetitions; a null source is a source, the last one; null ids share one place;
repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import drop_written, written

#: Weights by the source's rank in code point order, repeating.
WEIGHTS = (5, 2, 1)
SLICES = 2048
#: Source tables of up to this many rows are broadcast; larger ones are joined with the documents' side salted.
SMALL_TABLE, SALTS = 10_000, 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(doc_id: Column, seed: int) -> Column:
    """Of a document, a seeded place below 2**44; the first 11 bits are its slice."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 11), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, size): one row for each source.

    Both windows run over one row a source, not over documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rising = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("wanted", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("clamped", F.coalesce(F.sum("source_size").over(rising), F.lit(0)) * epochs)
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
        .withColumn("level", (F.col("wanted") - F.col("clamped")) / (F.col("all_weights") - F.col("weight_before")))
        .withColumn("water", F.max("level").over(everything))
    )
    target = F.least(F.col("source_size") * epochs, F.col("water") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row, written: the texts are read and counted once."""
    return written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")


def mix_rates(sizes: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """From (doc_id, source, size) of all rows, for each source: source_size, target, and which of its rows are taken how often."""
    at = _place(F.col("doc_id"), seed)
    slices = written(sizes.groupBy("source", F.shiftright(at, 33).alias("slice")).agg(F.sum("size").alias("slice_size"), F.count("*").alias("rows")), "slices")
    targets = source_targets(slices.select("source", F.col("slice_size").alias("size")), share, epochs, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(rate + 1e-12)).withColumn("fraction", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    up_to = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = slices.withColumn("through", F.sum("slice_size").over(up_to)).withColumnRenamed("source", "_s")
    last = running.join(plan.select(F.col("source").alias("_t"), "fraction"), F.col("_s").eqNullSafe(F.col("_t"))).where(F.col("through") > F.col("fraction"))
    part = F.try_divide(F.col("fraction") - (F.col("through") - F.col("slice_size")), F.col("slice_size"))
    part = F.when(F.col("rows") == 1, F.round(part)).otherwise(part)
    edge = last.groupBy("_s").agg(F.min(F.struct("slice", part.alias("part"))).alias("edge"))
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_source"), "source_size", "target", "whole", F.coalesce("edge.slice", F.lit(SLICES)).alias("_slice"), F.coalesce("edge.part", F.lit(0.0)).alias("_part"))
    return written(plan, "rates")


def repeated(rows: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """``rows`` (doc_id, source and others) with source_size, target and repetitions by the rates of :func:`mix_rates`."""
    placed = rows.withColumn("_at", _place(F.col("doc_id"), seed))
    if plan.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        joined = placed.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = placed.withColumn("_own", F.pmod(F.col("_at"), F.lit(SALTS))).join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt"))).drop("_own", "_salt")
    of_slice = F.shiftright("_at", 33)
    inside = F.pmod(F.col("_at"), F.lit(1 << 33)) < F.col("_part") * float(1 << 33)
    extra = F.when((of_slice < F.col("_slice")) | ((of_slice == F.col("_slice")) & inside), 1).otherwise(0)
    return joined.withColumn("repetitions", (F.col("whole") + extra).cast("long")).drop("_at", "_source", "whole", "_slice", "_part")


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes = _sizes(docs)
    return repeated(sizes, mix_rates(sizes)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` repeated as the mix asks, rows of no repetition gone; documents without a word stay once."""
    sizes = _sizes(docs)
    plan = mix_rates(sizes)
    drop_written(sizes)
    found = repeated(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"), plan)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    times = F.when(wordless, F.lit(1).cast("long")).otherwise(F.col("repetitions"))
    return found.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 11))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS wanted, sum(weight) OVER () AS all_weights,
    coalesce(sum(source_size) OVER rising, 0)::DOUBLE * 2.0::DOUBLE AS clamped, coalesce(sum(weight) OVER rising, 0.0::DOUBLE) AS weight_before FROM w
    WINDOW rising AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (wanted - clamped) / (all_weights - weight_before) AS level FROM f),
t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(level) OVER () * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(target - whole * source_size, 0.0::DOUBLE) AS fraction FROM p),
b AS (SELECT source, place >> 33 AS slice, sum(size)::BIGINT AS slice_size, count(*) AS n FROM d GROUP BY ALL),
r AS (SELECT *, sum(slice_size) OVER (PARTITION BY source ORDER BY slice)::BIGINT AS through FROM b),
e AS (SELECT r.source, arg_min(slice, slice) AS slice, arg_min(CASE WHEN r.n = 1 THEN round((fraction - (through - slice_size)) / slice_size) ELSE (fraction - (through - slice_size)) / slice_size END, slice) AS part
    FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source WHERE through > fraction GROUP BY r.source)
SELECT d.doc_id, d.size, q.source_size, q.target,
    (d.size * (q.whole + CASE WHEN (d.place >> 33) < coalesce(e.slice, 2048) OR ((d.place >> 33) = e.slice AND (d.place % 8589934592) < e.part * 8589934592.0::DOUBLE) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
