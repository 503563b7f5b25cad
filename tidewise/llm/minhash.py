"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Method. A document's set holds its distinct word shingles. Each permutation of 64-bit hashes gives two values of the
signature, the set's minimum and its maximum, so half as many permutations are evaluated as the signature has
values; both match between two sets with the probability of their Jaccard similarity. Bands of the signature name
buckets; documents that share a bucket are candidates, and a candidate is linked only if the full sets say so.

Chance to miss a pair of similarity exactly 0.8: (1 - 0.8**6)**40 = 5e-6, and less above. Equal sets are
collapsed before banding, so a group of exact copies of any size is one candidate.

Defined results: null text, empty text and text without a word have an empty set, link with nothing and keep their
row; a text with fewer words than a shingle is one shingle; rows may repeat and share ids; extra columns stay away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import blocks, link_buckets, local_components
from .shared import drop_written, map_arrow, pieces, written
from .vectors import whole_groups
from .words import Buffer, mix

#: Bands and their rows; half of the bands are of minima, half of maxima.
BANDS, ROWS = 40, 6
PERMUTATIONS = BANDS * ROWS // 2
#: One bit of each signature value, as words of 60 bits; at a similarity of 0.8 a share of 0.9 of them agree
#: (standard deviation 0.019), so a pair with under 0.79 agreeing isn't looked at further.
SKETCH_WORDS, SKETCH_BITS, LEAST_AGREEING = 4, 60, 0.79
#: Text bytes in one pass: the hashes of a pass stay in the processor's cache.
PASS_BYTES = 1 << 20
#: Members of a block of a crowded bucket, and shingles multiplied out at once.
BLOCK, COLUMNS = 600, 4096


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``size`` words."""
    buffer = Buffer.of_raw(texts)
    word = buffer.word_hash()
    n = max(0, len(word) - size + 1)
    hashed = np.full(n, size, np.uint64)
    for k in range(size):
        hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    out, at = [], 0
    for words in buffer.words.tolist():
        if words >= size:
            out.append(np.unique(hashed[at : at + words - size + 1]))
        else:
            short = np.full(min(words, 1), words, np.uint64)
            for k in range(words):
                short = mix(short * np.uint64(0x9E3779B97F4A7C15) + word[at + k])
            out.append(short)
        at += words
    return out


def signatures(sets: list[np.ndarray], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (sets, BANDS) and sketches (sets, SKETCH_WORDS) of sets that aren't empty."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    everything = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    value = np.empty((2, PERMUTATIONS, len(sets)), np.uint64)
    permuted = np.empty_like(everything)
    for p in range(PERMUTATIONS):
        np.multiply(everything, factor[p], out=permuted)
        permuted += shift[p]
        np.minimum.reduceat(permuted, first, out=value[0, p])
        np.maximum.reduceat(permuted, first, out=value[1, p])
    value = value.reshape(BANDS, ROWS, len(sets))
    band = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(sets), axis=1)
    for r in range(ROWS):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + value[:, r])
    bits = (mix(value.reshape(SKETCH_WORDS, SKETCH_BITS, len(sets))) & np.uint64(1)) << np.arange(SKETCH_BITS, dtype=np.uint64)[None, :, None]
    return band.T.view(np.int64), np.bitwise_or.reduce(bits, axis=1).T.view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """rid, doc_id, text_hash, digest (null for an empty set), n_shingles, bands, s0.. of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, most=PASS_BYTES):
            sets = shingle_sets(part.column("text").fill_null("").cast(pa.binary()).to_pylist(), size)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands, sketch = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), SKETCH_WORDS), np.int64)
            if full:
                bands[full], sketch[full] = signatures([sets[k] for k in full])
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), part.column("doc_id"), part.column("text_hash"), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(bands).ravel())), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH_WORDS))],
                names=["rid", "doc_id", "text_hash", "digest", "n_shingles", "bands", *(f"s{k}" for k in range(SKETCH_WORDS))],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketches = ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))
    return map_arrow(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, f"rid long, doc_id {id_type}, text_hash long, digest binary, n_shingles long, bands array<long>, {sketches}")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, hashes of the wanted (node, doc_id, text_hash, digest); rows of one id meet by their texts, so that a repeated id is no product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, most=PASS_BYTES):
            sets = shingle_sets(part.column("text").fill_null("").cast(pa.binary()).to_pylist(), size)
            same = [k for k, (s, d) in enumerate(zip(sets, part.column("digest").to_pylist())) if xxhash.xxh3_128_digest(s.tobytes()) == d]
            lengths = [len(sets[k]) for k in same]
            flat = np.concatenate([sets[k] for k in same]) if same else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(same, pa.int64())), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat.view(np.int64)))], names=["node", "hashes"])

    once = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = rows.join(wanted.withColumnsRenamed({"doc_id": "wanted_id", "text_hash": "wanted_hash"}), F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash")))
    sets = map_arrow(found.select("node", "digest", "text"), run, "node long, hashes array<long>")
    return sets if once else sets.dropDuplicates(["node"])


def _linked_within(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each task the smallest member of its group that each member reaches, by exact set sizes from 0/1 matrix products."""
    for batch, starts in whole_groups(batches, "task"):
        nodes, block, across = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "block", "across"))
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            hashes = batch.column("hashes").slice(a, b - a)
            size = np.diff(hashes.offsets.to_numpy())
            member = np.repeat(np.arange(b - a), size)
            _, inverse, times = np.unique(hashes.flatten().to_numpy(), return_inverse=True, return_counts=True)
            often = np.cumsum(times > 1) - 1
            of_two = times[inverse] > 1
            member, column = member[of_two], often[inverse[of_two]]
            order = np.argsort(column, kind="stable")
            member, column = member[order], column[order]
            shared = np.zeros((b - a, b - a), np.float32)
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                at, to = np.searchsorted(column, [first, first + COLUMNS])
                ones = np.zeros((b - a, COLUMNS), np.float32)
                ones[member[at:to], column[at:to] - first] = 1
                shared += ones @ ones.T
            linked = np.triu(100 * shared >= percent * (size[:, None] + size[None, :] - shared), 1)
            if across[a]:
                linked &= block[a:b, None] != block[None, a:b]
            i, j = np.nonzero(linked)
            label = local_components(b - a, i, j)
            moved = np.flatnonzero(label != np.arange(b - a))
            own = nodes[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(own[label[moved]]), pa.array(own[moved])], names=["a", "b"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept, and rid, one row for each row of ``docs``.

    Linked: 100 * shared shingles >= ``percent`` * shingles of both together, on full sets. Exactly one row of each
    component is kept where ids are unique: the one whose id is the component's.
    """
    signed = written(_signed(docs, size), "signed")
    classes = written(signed.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("node")), "classes")
    heads = signed.join(classes.select(F.col("node").alias("rid")), "rid")
    members = heads.select(F.col("rid").alias("node"), F.explode("bands").alias("bucket"))
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]
    features = heads.select(F.col("rid").alias("node"), F.col("n_shingles").alias("n"), *sketch)
    sets: list[DataFrame] = []

    def possible(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        differing = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in sketch[1:]), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differing <= int(SKETCH_WORDS * SKETCH_BITS * (1 - LEAST_AGREEING)))

    def prepare(nodes: DataFrame) -> None:
        wanted = nodes.join(signed.select(F.col("rid").alias("node"), "doc_id", "text_hash", "digest"), "node")
        sets.append(written(_full_sets(docs, wanted, size), "sets"))

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = sets[0].select(F.col("node").alias("a"), F.col("hashes").alias("p")), sets[0].select(F.col("node").alias("b"), F.col("hashes").alias("q"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("p") + F.size("q")).cast("long").alias("all"), F.size(F.array_intersect("p", "q")).cast("long").alias("shared"))
        return both.where(F.col("shared") * 100 >= (F.col("all") - F.col("shared")) * percent).select("a", "b")

    def dense(rows: DataFrame) -> DataFrame:
        tasks = blocks(rows, "bucket", "node", BLOCK).select("task", "across", "block", "node").join(sets[0], "node")
        dealt = tasks.repartition("task").sortWithinPartitions("task")
        return map_arrow(dealt, lambda batches: _linked_within(batches, percent), "a long, b long")

    comps = link_buckets(members, features, possible, verify, prepare, dense)
    drop_written(*sets)
    named = classes.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    whole = signed.select("rid", "doc_id", "digest", "n_shingles").join(named, "digest", "left").withColumn("comp", F.coalesce("comp", "rid"))
    whole = written(whole, "whole")
    smallest = written(whole.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "smallest")
    out = whole.join(smallest, "comp", "left").withColumn("component_id", F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    drop_written(signed, classes, comps)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "rid", "comp")


#: Shared shingles of every two documents, and reachability by links: all pairs by equality of shingles, for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
link AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(comp.b, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(comp.b, s.doc_id)) AS kept
FROM s LEFT JOIN comp ON comp.a = s.doc_id
"""


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents less all but one of each group of near-duplicates: the one of the smallest id stays.

    Where ids repeat, rows are numbered first, and of the rows with a group's smallest id one stays.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        gone = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("gone"))
        return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
    numbered = written(rows.withColumn("place", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col("place").alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias("place"), "component_id")
    best = numbered.select("place", "doc_id").join(found, "place").groupBy("component_id").agg(F.min(F.struct("doc_id", "place")).alias("best"))
    return numbered.join(best.select("best.place"), "place", "left_semi").select("row.*")
