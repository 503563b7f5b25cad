"""Connected components and bucketed linking as DataFrame jobs; nothing of a corpus' size comes to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, map_arrow, written


#: Edges up to which one task finds the components (some 50 MB); beyond it rounds of joins do.
FEW_EDGES = 1_000_000


def _few_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[b.column(c).to_numpy() for c in ("u", "v")] for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        comp = nodes[local_components(len(nodes), at[: len(u)], at[len(u) :])]
        for a in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a : a + 100_000]), pa.array(comp[a : a + 100_000])], names=["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Alternating large and small stars: each round hangs a node's larger neighbours, then its smaller ones, below its
    smallest neighbour; the rounds grow with the logarithm of the longest path. Sums and minima are combined before
    the shuffle and the joins are plain equi-joins, which skewed-join handling can split. Each round is written to the shared folder.
    Up to FEW_EDGES edges, a checked bound, one task does it at once, with the same result.
    Loops and repeated edges have no effect; no edges give no rows; null nodes are left out. The result is a written table.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if now.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        out = written(map_arrow(now.repartition(1), _few_components, "node long, comp long"), "components")
        drop_written(now)
        return out

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        hung = both.join(least, F.col("u") == F.col("of")).where("v > u and v <> m").select(F.col("m").alias("u"), "v").distinct()
        lower = hung.groupBy("v").agg(F.min("u").alias("m"))
        below = hung.join(lower.withColumnRenamed("v", "of"), F.col("v") == F.col("of")).where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        after = written(below.union(lower.select(F.col("m").alias("u"), "v")).distinct(), "edges")
        drop_written(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    out = written(now.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(now.select("u", "u").distinct()), "components")
    drop_written(now)
    return out


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after further links (a, b) between nodes, which may be new."""
    a, b = comps.select(F.col("node").alias("a"), F.col("comp").alias("u")), comps.select(F.col("node").alias("b"), F.col("comp").alias("v"))
    joined = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b"))
    found = components(joined)
    over = found.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
    moved = comps.join(over, "comp", "left").select("node", F.coalesce("over", "comp").alias("comp"))
    fresh = over.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("over").alias("comp"))
    out = written(moved.union(fresh), "components")
    drop_written(found)
    return out


#: Open pairs a member that make a bucket crowded.
CROWDED = 8


def blocks(rows: DataFrame, group: str, node: str, most: int) -> DataFrame:
    """Cut large groups: a row for each meeting of a row's block with another; columns task, across, block are added.

    Groups of more than ``most`` rows are cut into blocks by a hash of ``node``, and each two blocks meet in a task of their own, so
    that every pair of a group is together in a task and no task is larger than two blocks.
    """
    large = rows.groupBy(group).agg(F.count("*").alias("k")).where(F.col("k") > most).select(group, F.ceil(F.col("k") / most).cast("int").alias("_blocks"))
    cut = rows.join(large, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    return cut.withColumn("task", F.xxhash64(group, low, high)).withColumn("across", low != high).drop("_blocks", "_other")


def local_components(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of 0..size-1 the smallest that it reaches by the links i-j."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        # a root follows its members, and all follow their roots
        np.minimum.at(label, before, label.copy())
        while (label != (label := label[label])).any():
            pass
        if (label == before).all():
            return label


def link_buckets(members: DataFrame, features: DataFrame, possible: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], None] = lambda nodes: None, dense: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node, comp of every node that has a link; no pair of nodes that share a bucket is left undecided.

    members: (node, bucket), each pair once, and maybe a struct f of features. features: (node, ...) a row for each node,
    for members without f. possible(x, y): a condition on
    the feature structs named x and y that every linked pair fulfils. verify(pairs a, b): the pairs that are linked.
    prepare(nodes): told once which nodes can be in a pair. dense(bucket, node, comp, f): links (a, b) that connect what is linked
    inside each bucket and not yet in one component, without a row for each pair.

    First every member is compared with its bucket's most central member only (the one whose buckets hold most members: of
    edited copies, the original), which settles groups of copies of any size in one comparison a copy. A pair that is still
    open then lies in two components. Buckets with many more open pairs than members are left to ``dense``; in
    the others the open pairs are compared, if possible() allows, and the members of a bucket's largest component are on
    one side only.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(sizes, "bucket"), "shared")
    central = written(shared.groupBy("node").agg(F.sum("n").alias("reach")), "central")
    carried = "f" in members.columns
    nodes = central if carried else written(central.select("node").join(features, "node").select("node", F.struct(*features.columns).alias("f")), "nodes")
    prepare(nodes.select("node"))
    placed = shared.drop("n").join(central, "node")
    grouped = written(placed if carried else placed.join(nodes, "node"), "grouped")
    drop_written(shared, *([central] if carried else [central, nodes]))
    pivots = grouped.groupBy("bucket").agg(F.max(F.struct("reach", "node", "f")).alias("m"))
    pivots = pivots.select("bucket", F.col("m.node").alias("pivot"), F.col("m.f").alias("x"))
    near = grouped.withColumnRenamed("f", "y").join(pivots, "bucket").where((F.col("node") != F.col("pivot")) & possible("x", "y"))
    comps = components(verify(near.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()))
    named = grouped.join(comps, "node", "left").select("bucket", "node", "f", F.coalesce("comp", "node").alias("comp"))
    parts = named.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
    crowded = (F.col("all") * F.col("all") - F.col("same")) / 2 > CROWDED * F.col("all") if dense else F.lit(False)
    opened = buckets.where(F.col("most.n") < F.col("all")).select("bucket", F.col("most.comp").alias("main"), crowded.alias("crowded"))
    rows = written(named.join(opened, "bucket"), "open-rows")
    minor = rows.where("comp <> main and not crowded").select("bucket", F.col("node").alias("a"), F.col("comp").alias("comp_a"), F.col("f").alias("x"))
    others = rows.where("not crowded").select("bucket", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("f").alias("y"))
    cross = minor.join(others, "bucket").where((F.col("comp_a") != F.col("comp_b")) & possible("x", "y"))
    links = verify(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if dense:
        links = links.union(dense(rows.where("crowded").select("bucket", "node", "comp", "f")))
    out = merged(comps, links)
    drop_written(rows, comps, grouped)
    return out
