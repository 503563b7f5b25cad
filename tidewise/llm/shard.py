"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of id, text checksum and size; a balanced Feistel network over the smallest even
number of bits that holds n permutes the numbers, and one that lands at n or above is permuted again until it lands
below (cycle walking), so the whole is a permutation of 0..n-1. Shard and slot are the permuted number modulo and
divided by the number of shards: anyone can compute where row r goes, and back, without a table.

Defined results: law `rows`; null text has size 1 and checksum 0; rows may repeat (equal rows are interchangeable); an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, written

ROUNDS = 4
#: Multipliers of the round function; both below 2**31, so products of halves of up to 31 bits stay below 2**63.
FIRST, SECOND = 0x45D9F3B, 0x2C1B3C6D


def half_bits(rows: int) -> int:
    """Bits of each half of the network for numbers below ``rows``."""
    return max(1, ((rows - 1).bit_length() + 1) // 2) if rows > 1 else 1


def round_keys(seed: int) -> list[int]:
    return [(seed * 7919 + 104729 * (k + 1)) % ((1 << 31) - 1) for k in range(ROUNDS)]


def mixed(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (half * FIRST + key) & 0x7FFFFFFF
    x = x ^ (x >> 13)
    x = (x * SECOND) & 0x7FFFFFFF
    return (x ^ (x >> 11)) & mask


def permute(number: np.ndarray, rows: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..rows-1, or with ``back`` its inverse."""
    bits, keys = half_bits(rows), round_keys(seed)
    mask = (1 << bits) - 1
    out = number.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        high, low = out[todo] >> bits, out[todo] & mask
        for key in reversed(keys) if back else keys:
            if back:
                high, low = low ^ mixed(high, key, mask), high
            else:
                high, low = low, high ^ mixed(low, key, mask)
        out[todo] = high << bits | low
        todo = todo[out[todo] >= rows]
    return out


def sharded(docs: DataFrame, shards: int = 8, seed: int = 29) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row (the global row number) of every document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    light = written(light, "light")
    order = ["doc_id", "text_crc32", "size"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = light.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    numbered = written(numbered, "numbered")
    part = F.shiftright("at", 33)
    # a row for each partition of the shuffle, however many rows there are
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    rows, before = sum(n for _, n in counts), np.zeros(counts[-1][0] + 1 if counts else 1, np.int64)
    total = 0
    for k, n in counts:
        before[k] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            row = before[at >> 33] + (at & ((1 << 33) - 1))
            number = permute(row, rows, seed)
            n = len(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(["rows"] * n, pa.string()), pa.array((number % shards).astype(np.int32)), pa.array(number // shards), pa.nulls(n, pa.int32()), pa.array(row)],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(numbered, run, f"doc_id {id_type}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, row long")
