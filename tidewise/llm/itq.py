"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Method. On a bounded sample the vectors, less their mean, are projected on their principal directions, and rotations are learned
that bring them closest to the corners of the cube (alternating sign and Procrustes steps). Each bit is cut at the median that the
sample has there (a group's own, if the sample holds OWN of it), so that bits are balanced however concentrated the vectors lie. A code is cut into
substrings of ``bits`` bits; each names a Hamming table, and vectors that share a substring's value and their group are candidates.

The length of a substring follows the largest group. The number of tables is measured: sample vectors are turned towards others by exactly the
angle of the threshold, and as many tables are used as find all but MISS of these pairs; where MOST tables don't, the substrings are shortened.
Such a pair is as far apart as a link can be, so links are found oftener. The Hamming distance of CODE bits of the codes ranks out
candidates that are farther apart than all but a 5000th of those pairs.

First only codes travel, and only members of a table that have a candidate in reach go on; their vectors are then compared by cosine on the
original vectors, in double precision. Equal vectors of a group are one class before hashing, so copies of any number cost one row. Buckets
above BLOCK classes are cut into blocks and each two blocks meet in a task of their own: all pairs are looked at, none is emitted.
A pair that shares several tables counts in the first of them only.

Defined results: a null label, a null, empty or zero vector, or one with null or non-finite components links with nothing;
vectors of different length don't link; repeated rows are vectors like others, and where an id stands on several rows each has its own
vector's links and component; a row of null id links like others and is no component's id while another id is in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import blocks, components, local_components
from .shared import drop_written, map_arrow, written
from .vectors import matrix, sample_labelled, usable, whole_groups

#: Bounds of the fitting sample: vectors, and of them those that rotations are learned from and that pairs are made of.
SAMPLE, ROTATED, PAIRS = 20_000, 4_000, 10_000
MISS, BUCKET, BLOCK, MOST, OWN = 5e-4, 64, 1500, 64, 200
#: Bits of the code that is compared by Hamming distance.
CODE = 128
STEPS = 20


@dataclass
class Codes:
    mean: np.ndarray  # (d,)
    project: np.ndarray  # (d, k), principal directions
    rotations: np.ndarray  # (k, columns), orthonormal k by k
    median: np.ndarray  # (columns,)
    own: dict = field(default_factory=dict)  # group: its medians
    bits: int = 1
    tables: int = 1
    radius: int = CODE

    def signs(self, unit: np.ndarray, groups: list | None = None) -> np.ndarray:
        """(rows, columns): the bits of unit vectors."""
        if unit.shape[1] == len(self.mean):
            low = (unit - self.mean) @ self.project
        else:
            low = unit @ np.random.default_rng(unit.shape[1]).normal(size=(unit.shape[1], self.project.shape[1]))
        place = low @ self.rotations
        if not self.own or groups is None:
            return place > self.median
        cut = np.stack([self.own.get(g, self.median) for g in groups])
        return place > cut

    def substrings(self, signs: np.ndarray) -> np.ndarray:
        """(rows, tables): the value of each substring."""
        cut = signs[:, : self.bits * self.tables].reshape(len(signs), self.tables, self.bits)
        return cut @ (1 << np.arange(self.bits))

    def codes(self, signs: np.ndarray) -> np.ndarray:
        """(rows, CODE / 64) unsigned words."""
        whole = np.zeros((len(signs), CODE), np.uint8)
        n = min(CODE, signs.shape[1])
        whole[:, :n] = signs[:, :n]
        return np.packbits(whole, axis=1).view(np.uint64)


def wanted_bits(largest_group: int) -> int:
    """Bits of a substring at which balanced buckets of the largest group hold about BUCKET."""
    return max(4, min(24, math.ceil(math.log2(max(largest_group, 1) / BUCKET)))) if largest_group > 1 else 4


def learn(unit: np.ndarray, groups: list, largest_group: int, threshold: float, seed: int = 5) -> Codes:
    """Codes fitted to unit vectors of these groups: rotations, medians, and as many tables as the threshold asks for."""
    rng = np.random.default_rng(seed)
    mean = unit.mean(0)
    _, vectors = np.linalg.eigh((unit - mean).T @ (unit - mean))
    project = vectors[:, ::-1][:, :64]
    low = ((unit - mean) @ project)[:ROTATED]
    k, bits = project.shape[1], wanted_bits(largest_group)
    rotations = []
    for _ in range(-(-max(CODE, MOST * bits) // k)):
        rotation = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(STEPS if len(unit) > 1 else 0):
            left, _, right = np.linalg.svd(np.where(low @ rotation > 0, 1.0, -1.0).T @ low)
            rotation = (left @ right).T
        rotations.append(rotation[:, rng.permutation(k)])
    found = Codes(mean, project, np.concatenate(rotations, axis=1), np.zeros(0))
    place = (unit - mean) @ project @ found.rotations
    found.median = np.median(place, axis=0)
    at: dict = {}
    for row, group in enumerate(groups):
        at.setdefault(group, []).append(row)
    found.own = {g: np.median(place[rows], axis=0) for g, rows in at.items() if len(rows) >= OWN}
    # pairs at the threshold: a vector, turned towards another of the sample
    first, second = rng.integers(0, len(unit), (2, PAIRS))
    aside = unit[second] - (unit[first] * unit[second]).sum(1, keepdims=True) * unit[first]
    length = np.linalg.norm(aside, axis=1)
    first, aside = first[length > 1e-9], aside[length > 1e-9] / length[length > 1e-9, None]
    if not len(first):
        found.bits = bits
        return found
    turned = threshold * unit[first] + math.sqrt(1 - threshold**2) * aside
    own = [groups[i] for i in first.tolist()]
    a, b = found.signs(unit[first], own), found.signs(turned, own)
    found.radius = int(np.quantile((a[:, :CODE] != b[:, :CODE]).sum(1), 1 - 2e-4, method="higher"))
    for found.bits in range(bits, 0, -1):
        found.tables = min(MOST, a.shape[1] // found.bits)
        same = (found.substrings(a) == found.substrings(b)).cumsum(1) > 0
        reached = np.flatnonzero((~same).mean(0) <= MISS)
        if len(reached):
            found.tables = int(reached[0]) + 1
            break
    return found


def _in_reach(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """bucket, node of those rows that have another of their task (of the other block, if two meet) within the radius."""
    for batch, starts in whole_groups(batches, "task"):
        code = np.stack([batch.column(f"c{k}").to_numpy().view(np.uint64) for k in range(CODE // 64)])
        block, across = batch.column("block").to_numpy(), batch.column("across").to_numpy(zero_copy_only=False)
        kept = np.zeros(batch.num_rows, bool)
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            near = sum(np.bitwise_count(c[a:b, None] ^ c[None, a:b]).astype(np.int16) for c in code) <= radius
            if across[a]:
                near &= block[a:b, None] != block[None, a:b]
            np.fill_diagonal(near, False)
            kept[a:b] = near.any(0)
        yield batch.select(["bucket", "node"]).filter(pa.array(kept))


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each task: links of a class found in it (a weighted count), and its smallest class reachable in it."""
    for batch, starts in whole_groups(batches, "task"):
        node, weight, block = (batch.column(c).to_numpy() for c in ("node", "n", "block"))
        table, side = batch.column("table").to_numpy(), batch.column("across").to_numpy(zero_copy_only=False)
        values = batch.column("found").flatten().to_numpy().reshape(batch.num_rows, -1)
        for a, b in zip(starts, starts[1:]):
            if b - a < 2:
                continue
            own, t = slice(a, b), int(table[a])
            vectors = matrix(batch.column("embedding").slice(int(a), int(b - a)))
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            close = np.triu(vectors @ vectors.T >= threshold, 1)
            if side[a]:
                close &= block[own][:, None] != block[own][None, :]
            i, j = np.nonzero(close)
            if not len(i):
                continue
            mine = values[own]
            earlier = np.zeros(len(i), bool)
            for k in range(t):
                earlier |= mine[i, k] == mine[j, k]
            fresh_i, fresh_j = i[~earlier], j[~earlier]
            if not len(fresh_i):
                continue
            size, w = b - a, weight[own].astype(np.int64)
            counted = np.bincount(fresh_i, w[fresh_j], size) + np.bincount(fresh_j, w[fresh_i], size)
            ids = node[own]
            by_id = np.argsort(ids, kind="stable")
            rank = np.empty(size, np.int64)
            rank[by_id] = np.arange(size)
            least = ids[by_id][local_components(size, rank[fresh_i], rank[fresh_j])[rank]]
            hit = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(counted[hit].astype(np.int64)), pa.array(least[hit])], names=["node", "links", "least"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, group: str = "label", name: str = "embedding", id_name: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; rows link within a ``group`` at a cosine of at least ``threshold``."""
    rows = vectors.select(F.col(id_name).cast("long").alias("vec_id"), F.col(group).alias("label"), F.col(name).alias("embedding"))
    able = usable(F.col("embedding")) & F.col("label").isNotNull()
    classes = written(rows.where(able).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    facts = classes.groupBy("label").agg(F.count("*").alias("k")).agg(F.max("k").alias("largest"), F.sum("k").alias("all")).first()
    unit, groups = sample_labelled(classes, "embedding", F.col("label").cast("string"), SAMPLE, facts["all"] or 0, 5)
    shared = vectors.sparkSession.sparkContext.broadcast(learn(unit, groups, facts["largest"] or 1, threshold) if len(unit) else None)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lengths = np.diff(batch.column("embedding").offsets.to_numpy())
                label = batch.column("name").to_pylist()
                found, code = np.zeros((batch.num_rows, codes.tables), np.int32), np.zeros((batch.num_rows, CODE // 64), np.uint64)
                for length in np.unique(lengths):
                    own = np.flatnonzero(lengths == length)
                    unit = matrix(batch.column("embedding").take(pa.array(own)))
                    signs = codes.signs(unit / np.linalg.norm(unit, axis=1, keepdims=True), [label[k] for k in own.tolist()])
                    found[own], code[own] = codes.substrings(signs), codes.codes(signs)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(lengths.astype(np.int32)), batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel())), *(pa.array(np.ascontiguousarray(code[:, k]).view(np.int64)) for k in range(CODE // 64))], names=["label", "length", "node", "found", *words])

    words = [f"c{k}" for k in range(CODE // 64)]
    label_type = rows.schema["label"].dataType.simpleString()
    schema = f"label {label_type}, length int, node long, found array<int>, " + ", ".join(f"{w} long" for w in words)
    coded = written(map_arrow(classes.select("label", F.col("label").cast("string").alias("name"), "embedding", "node"), hashed, schema), "coded")
    spread = coded.select("label", "length", "node", *words, F.posexplode("found").alias("table", "value"))
    placed = spread.select(F.xxhash64("label", "table", "value", "length").alias("bucket"), "table", "node", *words)
    dealt = blocks(placed, "bucket", "node", BLOCK).select("task", "across", "block", "bucket", "node", *words).repartition("task").sortWithinPartitions("task")
    radius = shared.value.radius if len(unit) else 0
    reached = map_arrow(dealt, lambda batches: _in_reach(batches, radius), "bucket long, node long").distinct()
    near = written(reached, "reached")
    tables = placed.select(F.col("bucket").alias("_b"), F.col("node").alias("_n"), "table")
    going = near.join(tables, (F.col("bucket") == F.col("_b")) & (F.col("node") == F.col("_n"))).select("bucket", "table", "node")
    tasks = blocks(going, "bucket", "node", BLOCK).select("task", "across", "table", "node", "block").join(classes.select("node", "n", "embedding"), "node").join(coded.select("node", "found"), "node")
    dealt = tasks.repartition("task").sortWithinPartitions("task")
    found = written(map_arrow(dealt, lambda batches: _links(batches, threshold), "node long, links long, least long"), "found")
    comps = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "node", "left").join(comps, "node", "left").select("label", "embedding", "n", "links", "id", F.coalesce("comp", "node").alias("comp"))
    named = written(named, "named")
    smallest = named.groupBy("comp").agg(F.min("id").alias("least"))
    named = written(named.join(smallest, "comp"), "named")
    drop_written(coded, near, found, comps, classes)
    joined_by = named.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), F.coalesce("links", F.lit(0)).alias("links"), "n", "least")
    joined = rows.withColumn("able", able).join(joined_by, F.col("able") & (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    component = F.coalesce("least", "vec_id")
    links = F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long")
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"))


#: Every pair of a label is compared here; the operator finds those whose codes meet, which on pairs well above the threshold is all.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(comp.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(comp.b, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN comp ON comp.a = v.vec_id
"""
