"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Format. A token folder is a Parquet table written by Spark (so any store that Spark reaches will do) with one row a block:
part and block order the blocks, docs holds the document ids, lengths their token counts, before the tokens of the
part ahead of the block, control and data the coded ids; ``ranks`` beside it holds the id of every rank. Ids are
replaced by their rank in the corpus' frequency (ties to the smaller id), so frequent ids need one byte. Four ranks
share a control byte, two bits each: the number of data bytes less one; the data bytes are little-endian. Decoding looks the
lengths of four ranks up by control byte and gathers the bytes with numpy, without a step for each id.

Blocks stand in ascending document order: documents are dealt by ranges of their id, and each range is one part.

Defined results: null text is empty and has only the end id; special-token strings in a text are found by
the tokenizer as it does by default; rows may repeat; an empty table gives an empty folder.
"""

from __future__ import annotations

import itertools
import json
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_written, map_arrow, pieces, without_collection, written

#: Tokens after which a block ends; a longer document makes a block of its own.
BLOCK_TOKENS = 1 << 16
REMEMBERED = 400_000
#: Data bytes of the four ranks of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned values below 2**32."""
    values = values.astype(np.uint32)
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values of :func:`encode`: lengths by table, then each byte of the values that have it."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    data = np.frombuffer(data, np.uint8)
    start = np.cumsum(size, dtype=np.int64) - size
    out = data[start].astype(np.int64)
    at = np.arange(count)
    for k in range(1, 4):
        at = at[size[at] > k]
        if not len(at):
            break
        out[at] |= data[start[at] + k].astype(np.int64) << (8 * k)
    return out


#: The parts of a tokenizer's description for which words may be encoded apart; any other takes the longer way.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

_marks = re.compile("[\u0300-\u036f]").search
#: At the end of a word a run of these is one piece.
ENDING = string.punctuation


def byte_letters() -> dict[int, str]:
    """The characters that byte-level tokenizers write for the bytes 0 to 255: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class WordEncoder:
    """The tokenizers library behind a memory of words.

    For a tokenizer that lower-cases, drops white space and splits at it, a text's ids are those of its words one after
    another, whatever the case of a to z (unless marks that combine with letters are about), and a run of ASCII marks
    after letters is a piece of its own. Words of plain letters that the normaliser leaves alone go straight to the
    library's merging model; all others through the whole tokenizer, told apart by the offsets it returns. That this
    holds is checked on the tokenizer's own description, patterns, settings and added tokens included; any other encodes whole texts.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        made = json.loads(content)
        settings = {k: v for k, v in made["model"].items() if k not in ("vocab", "merges")}
        added = [t["content"].rstrip(ENDING) for t in made.get("added_tokens", [])]
        apart = all(x and not x.isalpha() for x in added)  # letters and marks after them hold no added token
        self.plain = made.get("normalizer") == NORMALIZER and made.get("pre_tokenizer") == PRE_TOKENIZER and made.get("post_processor") is None and settings == MODEL and apart
        self.letters = byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.memory: dict[str, int] = {"": 0}
        self.tails: dict[str, list[int]] = {"": []}
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _simple(self, word: str) -> bool:
        return word.isalpha() and (word.islower() if word.isascii() else word == word.lower() and unicodedata.is_normalized("NFC", word))

    def _learn(self, fresh: list[str]) -> np.ndarray:
        """Remember words that aren't known; the number that each gets."""
        letters, simple = self.letters, self._simple
        bodies = [word.rstrip(ENDING) for word in fresh]
        direct = [simple(body) for body in bodies]
        given = [body if body.isascii() else body.encode().decode("latin-1").translate(letters) for body in itertools.compress(bodies, direct)]
        ends = [word[len(body) :] for word, body in itertools.compress(zip(fresh, bodies), direct)]
        self.tails.update((end, self.tokenizer.encode(end, add_special_tokens=False).ids) for end in set(ends).difference(self.tails))
        found = [[t.id for t in tokens] + self.tails[end] for tokens, end in zip(map(self.model.tokenize, given), ends)]
        sizes = [np.fromiter(map(len, found), np.int64, len(found))]
        ids = [np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes[0].sum()))]
        rest = [word for word, known in zip(fresh, direct) if not known]
        for at in range(0, len(rest), 20_000):
            words = rest[at : at + 20_000]
            coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in words)])
            owner = np.searchsorted(starts, np.array([o[0] for o in coded.offsets], np.int64), side="right") - 1
            sizes.append(np.bincount(owner, minlength=len(words)))
            ids.append(np.array(coded.ids, np.uint32))
        # those that went straight to the model come first
        numbers = np.empty(len(fresh), np.int64)
        numbers[np.argsort(~np.array(direct, bool), kind="stable")] = np.arange(len(self.size), len(self.size) + len(fresh))
        self.memory.update(zip(fresh, numbers.tolist()))
        size = np.concatenate(sizes)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *ids])
        return numbers

    def encode_many(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each followed by ``end``, and how many each has."""
        if not self.plain or not texts:
            found = [[*self.tokenizer.encode(t, add_special_tokens=False).ids, end] for t in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
        with without_collection():
            return self._encode_many(texts, end)

    def _encode_many(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memory) > REMEMBERED:
            self._forget()
        cased, counts = [], []
        for text in texts:
            raw = text.encode()
            if text.isascii() or not _marks(text):
                raw = raw.lower()
            raw = raw.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ")
            cased.append(raw)
            counts.append(raw.count(b" ") + 2)
        # each different word of the texts is looked up once
        words = pc.split_pattern(pa.array([b" ".join(cased)], pa.binary()), " ").values.dictionary_encode()
        different = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), b" ")[0].as_py().decode().split(" ")
        known = np.fromiter(map(self.memory.get, different, itertools.repeat(-1)), np.int64, len(different))
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            known[fresh] = self._learn([different[k] for k in fresh.tolist()])
        known = known[words.indices.to_numpy()]
        stops = np.cumsum(counts) - 1
        at = np.full(len(known) + len(texts), -1, np.int64)
        inner = np.ones(len(at), bool)
        inner[stops] = False
        at[inner] = known
        size = np.where(inner, self.size[at], 1)
        edge = np.cumsum(size)
        place = np.repeat(self.start[at] - edge + size, size)
        place += np.arange(len(place))
        ends = edge[stops]
        place[ends - 1] = 0
        ids = self.ids[place] if len(self.ids) else np.zeros(len(place), np.uint32)
        ids[ends - 1] = end
        return ids, np.diff(ends, prepend=0)


_made: dict[int, WordEncoder] = {}


def _worker_copy(content: str) -> WordEncoder:
    key = hash(content)
    if key not in _made:
        _made.clear()
        _made[key] = WordEncoder(content)
    return _made[key]


def _ascending_blocks(docs: DataFrame, content, end: int, width: str) -> DataFrame:
    """part, block, before, docs, lengths, ids (``width``) of tokenized documents in ascending order of id."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _worker_copy(content.value), TaskContext.get().partitionId()
        block, before, total = 0, 0, np.zeros(0, np.int64)
        names = ["part", "block", "before", "docs", "lengths", "ids", "counts"]
        for piece in pieces(batches, most=1 << 20):
            ids, lengths = encoder.encode_many([x or "" for x in piece.column("text").to_pylist()], end)
            found = np.bincount(ids)
            total = found + np.pad(total, (0, len(found) - len(total))) if len(found) > len(total) else total + np.pad(found, (0, len(total) - len(found)))
            ends = np.cumsum(lengths)
            slot = (ends - 1) // BLOCK_TOKENS
            cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(lengths)]
            for a, b in zip(cuts, cuts[1:]):
                first, last = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
                rows = [pa.array([part]), pa.array([block]), pa.array([before]), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), piece.column("doc_id").slice(a, b - a)), pa.array([lengths[a:b]], pa.list_(pa.int64())), pa.array([ids[first:last].astype(width).tobytes()])]
                yield pa.RecordBatch.from_arrays([*rows, pa.nulls(1, pa.binary())], names=names)
                block, before = block + 1, before + last - first
        if block:
            # how often each id occurred in the part, in a row of its own
            rows = [pa.array([part]), pa.array([-1]), pa.array([before]), pa.array([[]], pa.list_(piece.schema.field("doc_id").type)), pa.array([[]], pa.list_(pa.int64())), pa.array([b""]), pa.array([total.tobytes()])]
            yield pa.RecordBatch.from_arrays(rows, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(ordered, run, f"part long, block long, before long, docs array<{kind}>, lengths array<long>, ids binary, counts binary")


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2) -> str:
    """Write the token folder of ``docs`` to the shared folder; its path.

    The ranks are one row for each id of the vocabulary, whose size is a constant of the tokenizer's file.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        described = file.read()
    made = json.loads(described)
    largest = max(end, *made["model"]["vocab"].values(), *(t["id"] for t in made.get("added_tokens", [])))
    width = "<u2" if largest < 1 << 16 else "<u4"
    content = spark.sparkContext.broadcast(described)
    staged = written(_ascending_blocks(docs, content, end, width), "staged")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                found = np.frombuffer(raw, np.int64)
                most = max(len(found), len(total))
                total = np.pad(total, (0, most - len(total))) + np.pad(found, (0, most - len(found)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = map_arrow(staged.where("block = -1").select("counts"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank_of)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode(shared.value[np.frombuffer(raw, width)]) for raw in batch.column("ids").to_pylist()]
            kept = ["part", "block", "before", "docs", "lengths"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())], names=[*kept, "control", "data"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in staged.schema if f.name not in ("ids", "counts"))
    folder = written(map_arrow(staged.where("block >= 0").drop("counts"), code, f"{schema}, control binary, data binary"), "tokens")
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{folder._tidewise_path}-ranks")
    drop_written(staged)
    return folder._tidewise_path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a token folder, from its files alone, ranks included."""
    folder = spark.read.parquet(path)
    # a row for each id of the vocabulary
    ranks = {r["rank"]: r["id"] for r in spark.read.schema("rank long, id long").parquet(f"{path}-ranks").collect()}
    by_rank = np.array([ranks[k] for k in range(len(ranks))], np.int64)
    # a row for each part of the folder
    sums = sorted((r["part"], r["n"]) for r in folder.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    starts = dict(zip((p for p, _ in sums), np.cumsum([0, *(n for _, n in sums)]).tolist()))
    shared = spark.sparkContext.broadcast(by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = np.array(batch.column("lengths")[k].as_py(), np.int64)
                ids = shared.value[decode(batch.column("control")[k].as_py(), batch.column("data")[k].as_py(), int(lengths.sum()))].astype("<u4")
                ends = np.cumsum(lengths)
                first = starts[batch.column("part")[k].as_py()] + batch.column("before")[k].as_py()
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("docs")[k].values, pa.array(first + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = folder.schema["docs"].dataType.elementType.simpleString()
    return map_arrow(folder, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, end))
