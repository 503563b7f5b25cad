"""What the vector operators share: valid rows, a bounded sample, and groups of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample_labelled(vectors: DataFrame, name: str, label: Column, rows: int, total: int, seed: int) -> tuple[np.ndarray, list]:
    """About ``rows`` vectors (the bound) of ``total``, chosen by a hash of the vector, as unit rows of the commonest length, and their labels."""
    place = F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(1 << 30))
    found = vectors.where(place < int(min(1.0, rows / max(total, 1)) * (1 << 30)) + 1).select(F.col(name).cast("array<double>").alias("v"), place.alias("p"), label.alias("l")).limit(2 * rows).collect()
    found = [(r["v"], r["l"]) for r in sorted(found, key=lambda r: (r["p"], r["v"], str(r["l"])))]
    if not found:
        return np.zeros((0, 1)), []
    lengths = [len(v) for v, _ in found]
    length = max(set(lengths), key=lambda k: (lengths.count(k), k))
    out = np.array([v for v, _ in found if len(v) == length])
    return out / np.linalg.norm(out, axis=1, keepdims=True), [x for v, x in found if len(v) == length]


def sample_rows(vectors: DataFrame, name: str, rows: int, total: int, seed: int) -> np.ndarray:
    return sample_labelled(vectors, name, F.lit(0), rows, total, seed)[0]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by ``key`` as batches that end where a group ends, and where each of their groups starts (with the end).

    Memory is bounded by a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        keys = whole.column(key).to_numpy(zero_copy_only=False)
        return whole, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield joined(held)
            held = []
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        if len(changes):
            cut = int(changes[-1]) + 1
            yield joined([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield joined(held)


