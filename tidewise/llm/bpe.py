"""Byte-level BPE: encode whole texts by a rank file and decode the ids again.

Method. A piece's byte positions are the leaves of a segment tree; a leaf holds ``rank * width + position`` of the pair
that starts there and an inner node the smaller of its children, so the root is the leftmost pair of minimum rank. A
merge changes three leaves (the pair's start, its removed right part, its live left neighbour) and repairs their
paths in logarithmic time. Many pieces of one width are merged in step, so the tree is walked by numpy.

Defined results: null text counts as empty (no ids); empty text gives no ids; special-token strings are plain text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, pieces

#: Entries a worker remembers before it starts afresh; about 0.25 kB each.
REMEMBERED = 200_000
#: Leaves merged in step at once.
LEAVES = 1 << 18
NONE = np.int64(1) << 62


class SegmentTreeBPE:
    """Encoder and decoder for one rank file (token bytes -> rank, the rank being the id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.base = max(ranks.values()) + 1
        joined = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    joined[left * self.base + right] = rank
        self.pairs = np.array(sorted(joined), np.int64)
        self.pair_rank = np.array([joined[k] for k in self.pairs.tolist()], np.int64)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = [b""] * self.base
        for token, rank in ranks.items():
            self.token[rank] = token
        self.decimal = [str(i) for i in range(self.base)]
        self.memory: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, lines: bytes, pattern: str) -> SegmentTreeBPE:
        """From the content of a file of lines ``base64 rank``."""
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}, pattern)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, NONE where it isn't in the vocabulary or a side is missing (negative)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], NONE)

    def merge(self, chunk: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most ``width`` bytes (a power of two), all merged in step."""
        n = len(chunk)
        length = np.fromiter(map(len, chunk), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width) < length[:, None]
        ids[:, :width][inside] = self.byte_id[np.frombuffer(b"".join(chunk), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[np.arange(n), length - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(rank < NONE, rank * width + np.arange(width), NONE)
        for top in (width >> k for k in range(1, width.bit_length())):
            tree[:, top : 2 * top] = np.minimum(tree[:, 2 * top : 4 * top : 2], tree[:, 2 * top + 1 : 4 * top : 2])
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            i = best % width
            gone = after[row, i]
            follower, leader = after[row, gone], before[row, i]
            ids[row, i] = best // width
            ids[row, gone] = -1
            after[row, i] = follower
            before[row, follower] = i  # column `width` takes what has no follower
            right = self.rank_of(ids[row, i], ids[row, follower])
            left = self.rank_of(np.where(leader >= 0, ids[row, leader], -1), ids[row, i])
            lead = np.maximum(leader, 0)
            rows, leaf = np.concatenate([row, row, row]), np.concatenate([gone, i, np.where(leader >= 0, lead, i)])
            value_i = np.where(right < NONE, right * width + i, NONE)
            tree[rows, leaf + width] = np.concatenate([np.full(len(row), NONE), value_i, np.where(leader >= 0, np.where(left < NONE, left * width + lead, NONE), value_i)])
            node = leaf + width
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] < NONE]
        live = ids[:, :width] >= 0
        flat, ends = ids[:, :width][live].tolist(), np.cumsum(live.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, fresh: set[str]) -> None:
        """Remember the ids of pieces not seen before."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in fresh:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.memory[piece] = (whole,)
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, found in by_width.items():
            step = max(1, LEAVES // width)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                for (piece, _), ids in zip(part, self.merge([raw for _, raw in part], width)):
                    self.memory[piece] = tuple(ids)

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        split = [self.split(text) for text in texts]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        self.learn({piece for found in split for piece in found if piece not in self.memory})
        memory = self.memory
        for found in split:
            ids: list[int] = []
            for piece in found:
                ids += memory[piece]
            yield ids

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


_made: dict[tuple[int, str], SegmentTreeBPE] = {}


def worker_copy(lines: bytes, pattern: str) -> SegmentTreeBPE:
    """One encoder a Python worker, kept between its tasks."""
    key = (hash(lines), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = SegmentTreeBPE.from_file(lines, pattern)
    return _made[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, [ids array<int>,] ids_sha256, decoded_sha256 of every whole text.

    ``vocabulary`` is a path the driver reads; its content (a file of fixed size) is broadcast. ``pattern`` splits the text
    before merging. The ids are the encoder's, the decoded digest is of the bytes those ids stand for.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        lines = spark.sparkContext.broadcast(file.read())
    ids_type = "ids array<int>, " if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_copy(lines.value, pattern)
        for part in pieces(batches, most=1 << 20):
            texts = [x or "" for x in part.column("text").to_pylist()]
            counts, all_ids, digest, decoded = [], [], [], []
            for ids in bpe.encode_many(texts):
                counts.append(len(ids))
                if with_ids:
                    all_ids.append(pa.array(ids, pa.int32()))
                digest.append(hashlib.sha256(" ".join([bpe.decimal[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [part.column("doc_id"), pa.array(counts, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.concat_arrays(all_ids or [pa.array([], pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digest), pa.array(decoded)], names=["doc_id", "n_tokens", *(["ids"] * with_ids), "ids_sha256", "decoded_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text")), run, f"doc_id {id_type}, n_tokens long, {ids_type}ids_sha256 string, decoded_sha256 string")
