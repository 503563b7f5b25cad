"""Approximate nearest neighbours by multiprobe p-stable hashing.

Method. A table's bucket of a unit vector is the row of floor((a_i . x + b_i) / w) for ``functions`` Gaussian a_i. A query
visits its own bucket and those whose perturbation is likeliest to hold neighbours: the score of a perturbation is the sum of squared distances
to the cell borders it crosses, and the best ``probes`` perturbations are found coordinate by coordinate (the best sums of a
prefix contain every prefix of a best sum, so the order is exact). Candidates of all tables are ranked
by cosine on the original vectors in double precision.

The number of functions follows the number of vectors; the number of probes is the smallest power of two at which
queries of a bounded sample find ``AIM`` of their true neighbours among the sample (whose neighbours are farther, so harder, than the table's).
A query that finds fewer than k is answered exactly, by a pass over all vectors in blocks of queries.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so only they are indexed; equal queries are searched once.

Defined results: null, empty and zero vectors and those with null or non-finite components take no part; vectors of
another length than the commonest take no part in the hashed search and are answered exactly; ties go to the smaller id; rows that repeat an id count
once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, map_arrow, written
from .vectors import matrix, sample_rows, usable, whole_groups

TABLES, WIDTH, AIM = 4, 1.0, 0.965
#: Bounds of the sample: vectors, and of them queries.
SAMPLE, SAMPLE_QUERIES = 6000, 150
MOST_PROBES = 2048
#: Vectors of a table in one task, and queries of an exact pass held at once.
TASK_ROWS, QUERY_BLOCK = 6000, 2048
#: Scores held at once.
CELLS = 1 << 22


@dataclass
class Hashes:
    a: np.ndarray  # (tables, d, functions)
    b: np.ndarray  # (tables, functions)
    key: np.ndarray  # (functions,) odd multipliers
    probes: int = 1

    def cells(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and the place inside each cell from 0 to 1."""
        at = (unit @ self.a[table] + self.b[table]) / WIDTH
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def name(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.key).sum(-1)

    def probe(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """(rows, probes) bucket names in order of estimated success; shorter if there are fewer perturbations."""
        cell, inside = self.cells(unit, table)
        steps = np.array([0, -1, 1, -2, 2, -3, 3])
        cost, shift = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for i in range(cell.shape[1]):
            x = inside[:, i : i + 1]
            border = np.where(steps < 0, x - steps - 1, steps - x) * (steps != 0)
            cost = (cost[:, :, None] + border[:, None, :] ** 2).reshape(len(unit), -1)
            with np.errstate(over="ignore"):
                shift = (shift[:, :, None] + (steps * self.key[i])[None, None, :]).reshape(len(unit), -1)
            if cost.shape[1] > probes:
                best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
                cost, shift = np.take_along_axis(cost, best, 1), np.take_along_axis(shift, best, 1)
        order = np.argsort(cost, axis=1, kind="stable")
        with np.errstate(over="ignore"):
            return self.name(cell)[:, None] + np.take_along_axis(shift, order, 1)


def _hashes(dimension: int, functions: int, seed: int) -> Hashes:
    rng = np.random.default_rng(seed)
    return Hashes(rng.normal(size=(TABLES, dimension, functions)), rng.uniform(0, WIDTH, (TABLES, functions)), rng.integers(1 << 40, 1 << 62, functions) * 2 + 1)


def tuned(sample: np.ndarray, total: int, k: int, seed: int = 3) -> Hashes:
    """Hashes whose probes reach AIM on the sample; with fewer functions, if no number of probes does."""
    functions = max(1, min(20, round(math.log2(max(total, 2) / 64) / 2)))
    while True:
        hashes = _hashes(sample.shape[1], functions, seed)
        if len(sample) < 2:
            return hashes
        asked = np.arange(min(SAMPLE_QUERIES, len(sample)))
        cosine = sample[asked] @ sample.T
        cosine[asked, asked] = -2
        true = np.argsort(-cosine, axis=1)[:, : min(k, len(sample) - 1)]
        first = np.full(true.shape, MOST_PROBES, np.int64)
        for t in range(TABLES):
            names = hashes.name(hashes.cells(sample, t)[0])[true]
            probed = hashes.probe(sample[asked], t, MOST_PROBES)
            match = probed[:, None, :] == names[:, :, None]
            first = np.minimum(first, np.where(match.any(2), match.argmax(2), MOST_PROBES))
        for probes in (1 << p for p in range(MOST_PROBES.bit_length())):
            if (first < probes).mean() >= AIM:
                hashes.probes = probes
                return hashes
        if functions == 1:
            hashes.probes = MOST_PROBES
            return hashes
        functions -= 1


def best_of(vectors: np.ndarray, norms: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of ``rows`` the k of ``own`` of largest cosine, ties to the smaller id: places in rows and in own, and the cosine.

    Candidates come from matrix products, in stretches of CELLS; the cosine of what is near the k-th is taken again pair by
    pair, so that equal vectors score equally whatever the shape of the product.
    """
    found = []
    step = max(1, CELLS // max(len(own), 1))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        scores = (vectors[some] @ vectors[own].T) / (norms[some][:, None] * norms[own])
        least = np.partition(scores, -k, axis=1)[:, -k] if len(own) > k else scores.min(1)
        i, j = np.nonzero(scores >= least[:, None] - 1e-12)
        exact = (vectors[some[i]] * vectors[own[j]]).sum(1) / (norms[some[i]] * norms[own[j]])
        order = np.lexsort((ids[own[j]], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        turn = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[turn < k] + at, j[turn < k], exact[turn < k]))
    return tuple(map(np.concatenate, zip(*found)))


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each task (a part of a table's buckets) the k best of each query among the buckets that it probes there."""
    for batch, starts in whole_groups(batches, "task"):
        for a, b in zip(starts, starts[1:]):
            group = batch.slice(int(a), int(b - a))
            asks = group.column("asks").to_numpy(zero_copy_only=False)
            stored, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(stored) or not len(queries):
                continue
            vectors, ids = matrix(group.column("v")), group.column("id").to_numpy()
            norms = np.linalg.norm(vectors, axis=1)
            names = [x.values.to_numpy() for x in group.column("names")]
            held = np.array([names[i][0] for i in stored])
            stored = stored[np.argsort(held, kind="stable")]
            held = np.sort(held, kind="stable")
            buckets, first = np.unique(held, return_index=True)
            first = np.append(first, len(held))
            asked = np.concatenate([names[q] for q in queries])
            asker = np.repeat(queries, [len(names[q]) for q in queries])
            at = np.minimum(np.searchsorted(buckets, asked), len(buckets) - 1)
            hit = buckets[at] == asked
            at, asker = at[hit], asker[hit]
            order = np.argsort(at, kind="stable")
            at, asker = at[order], asker[order]
            q_out, v_out, s_out = [], [], []
            turns = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else np.zeros(0, np.int64)
            for x, y in zip(turns, [*turns[1:], len(at)]):
                rows, own = asker[x:y], stored[first[at[x]] : first[at[x] + 1]]
                i, j, score = best_of(vectors, norms, rows, own, ids, k)
                q_out.append(ids[rows[i]]), v_out.append(ids[own[j]]), s_out.append(score)
            if not q_out:
                continue
            q, v, s = map(np.concatenate, (q_out, v_out, s_out))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            place = np.arange(len(q)) - np.repeat(np.flatnonzero(np.diff(q, prepend=q[0] - 1)), np.diff(np.append(np.flatnonzero(np.diff(q, prepend=q[0] - 1)), len(q))))
            kept = place < k
            yield pa.RecordBatch.from_arrays([pa.array(q[kept]), pa.array(v[kept]), pa.array(s[kept])], names=["query", "vec_id", "score"])


def _top(found: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _exact(spark, lacking: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k best of each lacking query (query, v) among all of ``index`` (id, v), a block of queries at a time."""
    out = None
    rows: list = []

    def passed(block: list) -> DataFrame:
        asked = spark.sparkContext.broadcast([(r["query"], np.array(r["v"], np.float64)) for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = np.diff(batch.column("v").offsets.to_numpy()) if batch.num_rows else np.zeros(0)
                for length in np.unique(lengths):
                    own = batch.take(pa.array(np.flatnonzero(lengths == length)))
                    mine = [(q, v) for q, v in asked.value if len(v) == length]
                    if mine:
                        both = np.concatenate([np.stack([v for _, v in mine]), matrix(own.column("v"))])
                        ids = np.concatenate([np.array([q for q, _ in mine], np.int64), own.column("id").to_numpy()])
                        i, j, score = best_of(both, np.linalg.norm(both, axis=1), np.arange(len(mine)), np.arange(len(mine), len(both)), ids, k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[len(mine) + j]), pa.array(score)], names=["query", "vec_id", "score"])

        return written(_top(map_arrow(index, run, "query long, vec_id long, score double"), "query", k).select("query", "vec_id", "score"), "exact")

    for row in lacking.toLocalIterator():
        rows.append(row)
        if len(rows) == QUERY_BLOCK:
            out, rows = passed(rows) if out is None else out.union(passed(rows)), []
    if rows:
        out = passed(rows) if out is None else out.union(passed(rows))
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, name: str = "embedding", id_name: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows found."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(name))).select(F.col(id_name).cast("long").alias("id"), F.col(name).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = written(rows.select("id", "v").distinct().withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "index")
    # queries that are equal are asked once, by the smallest id
    queries = written(rows.where("asks").groupBy("v").agg(F.min("id").alias("query")), "queries")
    total = index.count()
    sample = sample_rows(index, "v", SAMPLE, total, 3)
    hashes = tuned(sample, total, k) if len(sample) else _hashes(1, 1, 3)
    shared = spark.sparkContext.broadcast(hashes)
    dimension, parts = sample.shape[1], max(4, -(-total // TASK_ROWS))

    def spread(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    vectors = matrix(batch.column("v"))
                    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                    for t in range(TABLES):
                        if asks:
                            names = shared.value.probe(unit, t, shared.value.probes)
                            part = names % parts
                            order = np.argsort(part, axis=1, kind="stable")
                            part, names = np.take_along_axis(part, order, 1), np.take_along_axis(names, order, 1)
                            new = np.ones(part.shape, bool)
                            new[:, 1:] = part[:, 1:] != part[:, :-1]
                            row, _ = np.nonzero(new)
                            offsets = np.append(np.flatnonzero(new.ravel()), new.size).astype(np.int32)
                            task = t * parts + part[new]
                        else:
                            names = shared.value.name(shared.value.cells(unit, t)[0])
                            row, offsets, task = np.arange(batch.num_rows), np.arange(batch.num_rows + 1, dtype=np.int32), t * parts + names % parts
                        own = batch.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.full(len(row), asks)), own.column(0), own.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(names.ravel()))], names=["task", "asks", "id", "v", "names"])

        return run

    kind = rows.schema["v"].dataType.simpleString()
    schema = f"task long, asks boolean, id long, v {kind}, names array<long>"
    same = F.size("v") == dimension
    stored = map_arrow(index.where(same).select("id", "v"), spread(False), schema)
    asked = map_arrow(queries.where(same).select(F.col("query").alias("id"), "v"), spread(True), schema)
    # a task's stored rows beyond twice the usual are cut into blocks, each of which its queries visit
    large = stored.groupBy("task").agg(F.count("*").alias("k")).where(F.col("k") > 2 * TASK_ROWS).select(F.col("task").alias("_task"), F.ceil(F.col("k") / TASK_ROWS).cast("int").alias("_blocks"))
    large = F.broadcast(written(large, "large"))  # at most a row for each TASK_ROWS vectors and table
    stored, asked = (x.join(large, F.col("task") == F.col("_task"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))) for x in (stored, asked))
    stored = stored.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = stored.union(asked).withColumn("task", F.xxhash64("task", "_block")).drop("_task", "_blocks", "_block").repartition("task").sortWithinPartitions("task")
    found = map_arrow(dealt, lambda batches: _search(batches, k + 1), "query long, vec_id long, score double")
    best = written(_top(found.groupBy("query", "vec_id").agg(F.max("score").alias("score")), "query", k + 1).select("query", "vec_id", "score"), "best")
    enough = best.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, total))
    lacking = queries.join(enough, "query", "left_anti")
    exact = _exact(spark, lacking, index, k + 1)
    if exact is not None:
        best = best.join(exact.select("query").distinct(), "query", "left_anti").union(exact)
    asking = rows.where("asks").join(queries.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select(F.col("id").alias("query_id"), "query")
    own = asking.join(best, "query").where("vec_id <> query_id")
    return _top(own, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
