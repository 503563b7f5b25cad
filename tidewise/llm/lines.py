"""Fuzzy removal of repeated lines.

Method. Lines (split at line feeds) are normalised: lower case, runs of digits to one 0, everything that is neither
letter, digit nor underscore to single blanks. Equal normalised lines form a class. Each class is hashed by the grams (stretches of
a few characters) that it holds, its blocks are joined by pigeonhole, candidates are verified by edit similarity, 1 - distance / longer
length, and of each connected group one occurrence stays: the first by doc_id, then text hash, then line number.

Two hashes. In a plain SimHash every gram weighs the same, so one edited word flips bits in all blocks and pigeonhole blocks miss
most edited lines (measured in the README). The blocks are therefore drawn from a SimHash with steep weights: block i weighs
the grams by an order of its own in which the first outweighs all others, so its bits are those of that gram alone (the limit is
min-wise hashing), and an edit changes few blocks as a whole instead of a few bits of each. Sixteen blocks stand in a
square of four by four, and the tables are the twenty lines of the affine plane over it: five ways to cut the blocks into four groups of four.
Lines that differ in three blocks or fewer share a table in each of the five ways (pigeonhole), and most that differ in more
still share one. Lines that share a table are compared if their lengths allow it: no estimate rules a pair out that the tables
brought together. Plain SimHashes of 256 bits only tell which pairs of a crowded bucket come first.

Long lines are hashed by a sample of about SAMPLED grams, those whose hash is below a share that falls with the line's length
(a line's own content decides, so similar lines choose alike); the edit similarity is always that of whole lines.
Where one edit at most is allowed (under 20 characters at 0.9), lines share a form with at most one character left out, which
misses no pair; lines too short for any edit only repeat exactly.

No step gathers a table by rows: records of classes and of tables travel as packed bytes, a part for each partition. A value that holds
more than a few of a task's classes (a hot one) isn't gathered at all: its members go on as they are, dealt out evenly.

Defined results: every line that is not empty when normalised takes part, however short; null texts stay null; rows that repeat
both id and text count as one occurrence and are treated alike; a text keeps its other lines and their order; all columns are kept, whatever their names.
In joins a class goes by 64 bits of its digest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import alike, allowed
from .graph import blocks, link_buckets, local_components
from .shared import drop_written, map_arrow, pieces, written
from .vectors import whole_groups
from .words import mix

#: Least edit similarity, in percent of the longer line's length.
LEAST = 90
#: Characters of a gram for lines of so many characters or more: the longer two lines, the more short grams they share by chance.
GRAMS = ((0, 5), (100, 6), (250, 7))
#: Grams that a line is hashed by, and blocks of the hash (half by the smallest, half by the largest of an order).
SAMPLED, BLOCKS = 64, 16
#: Plain SimHashes have WORDS * 64 bits, by grams of WIDE_GRAMS[0] characters; those of lines from LONG characters on by grams of WIDE_GRAMS[1].
WORDS, LONG, WIDE_GRAMS, WIDE_SAMPLED = 4, 200, (5, 8), 128
#: Of a task's classes, how many share a value that isn't gathered; members of a bucket up to which those without a partner are left out first.
HOT, LARGE = 16, 2000
#: Records after which a task hands on what it has.
RECORDS = 1 << 17
#: Lines in a block of a crowded bucket, and characters of the grams whose shared number bounds the edits there.
BLOCK, COUNTED = 400, (1, 2)
#: Rows up to which a table is broadcast; larger ones are joined by shuffles.
SMALL_TABLE = 2_000_000

FULL = np.dtype([("name", "<u8"), ("rest", "<u8"), ("way", "<u4"), ("size", "<u4"), ("blocks", "<u2", BLOCKS)])
#: Names of the words of both SimHashes.
BITS = [f"h{k}" for k in range(2 * WORDS)]
SHORT = np.dtype([("name", "<u8"), ("rest", "<u8"), ("way", "<u4"), ("size", "<u4"), ("points", "<u4", 24)])
ENTRY = np.dtype([("key", "<u4"), ("size", "<u4"), ("name", "<u8")])
#: The size in the mark of a hot value.
MARK = 0xFFFFFFFF
_digit, _word = re.compile(r"\d").match, re.compile(r"\w").match


@cache
def _letters() -> np.ndarray:
    """What each character of the basic plane is normalised to: its lower case, 48 for digits, 32 for what is no word character."""
    out = np.full(1 << 16, 32, np.uint32)
    for point in range(1 << 16):
        if _digit(chr(point)):
            out[point] = 48
        elif _word(chr(point)):
            low = chr(point).lower()
            out[point] = ord(low) if len(low) == 1 else point
    out[10] = 10
    return out


def _normalised(points: np.ndarray) -> np.ndarray:
    """Code points after lower-casing, runs of blanks and digits as one, without blanks at the ends of lines."""
    beyond = points > 0xFFFF
    clean = _letters()[np.where(beyond, 0, points)] if beyond.any() else _letters()[points]
    if beyond.any():
        found, at = np.unique(points[beyond], return_inverse=True)
        kinds = [48 if _digit(chr(c)) else ord(chr(c).lower()) if _word(chr(c)) else 32 for c in found.tolist()]
        clean[beyond] = np.array(kinds, np.uint32)[at]
    blank, digit, end = clean == 32, clean == 48, clean == 10
    gone = np.zeros(len(clean), bool)
    gone[:1] = blank[:1]
    gone[1:] = (blank[1:] & (blank[:-1] | end[:-1])) | (digit[1:] & digit[:-1])
    clean = clean[~gone]
    gone = np.zeros(len(clean), bool)
    gone[:-1] = (clean[:-1] == 32) & (clean[1:] == 10)
    return clean[~gone]


class Lines:
    """The normalised lines of texts that aren't empty: code points, and of each line its start, size, text and number in the text."""

    def __init__(self, texts: list[str]):
        self.points = _normalised(np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32))
        ends = np.flatnonzero(self.points == 10)
        start = np.append(0, ends[:-1] + 1)
        many = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        text = np.repeat(np.arange(len(texts)), many)
        number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        full = np.flatnonzero(ends > start)
        self.start, self.size, self.text, self.number = start[full], (ends - start)[full], text[full], number[full]

    def digests(self) -> np.ndarray:
        """(lines, 2): the 128 bits that a class goes by, as its 64-bit name and the rest."""
        raw, at = memoryview(self.points.tobytes()), (4 * self.start).tolist()
        found = b"".join(xxhash.xxh3_128_digest(raw[a : a + 4 * n]) for a, n in zip(at, self.size.tolist()))
        return np.frombuffer(found, "<u8").reshape(-1, 2)

    def strings(self, which: np.ndarray) -> list[str]:
        text = self.points.tobytes().decode("utf-32-le", "surrogatepass")
        return [text[a : a + n] for a, n in zip(self.start[which].tolist(), self.size[which].tolist())]


def normalised(line: str) -> str:
    """Lower case, 0 for runs of digits, single blanks for what is neither letter, digit nor underscore."""
    return _normalised(np.frombuffer((line + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)).tobytes().decode("utf-32-le", "surrogatepass")[:-1]


def gram_hashes(points: np.ndarray, sizes: Iterable[int]) -> Iterator[np.ndarray]:
    """For each of the rising sizes, the raw hash of as many code points from each place on."""
    step = np.append(points, np.zeros(max(sizes), points.dtype)) * np.uint32(0x9E3779B1)
    hashed, width = step[: len(points)].copy(), 1
    for size in sizes:
        while width < size:
            hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B) + step[width : width + len(points)]
            width += 1
        yield hashed


def grams(raw: np.ndarray, start: np.ndarray, size: np.ndarray, gram: int, sampled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the sampled grams of lines of ``gram`` characters or more, where each line's begin, and how many it has."""
    many = size - gram + 1
    first = np.cumsum(many) - many
    hashed = raw[np.repeat(start - first, many) + np.arange(many.sum())]
    hashed ^= hashed >> np.uint32(13)
    hashed *= np.uint32(0xC2B2AE35)
    hashed ^= hashed >> np.uint32(16)
    below = (np.minimum(sampled / many, 1.0) * float((1 << 32) - 1)).astype(np.uint32)
    kept = hashed <= np.repeat(below, many)
    kept |= hashed == np.repeat(np.minimum.reduceat(hashed, first), many)
    many = np.add.reduceat(kept, first, dtype=np.int64)
    return hashed[kept], np.cumsum(many) - many, many


def plain_simhash(hashed: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """32 bits of each line: the majority of each bit over its grams, counted in the bytes of sums over at most 255 grams."""
    stretches = -(-many // 255)
    owner = np.repeat(np.arange(len(many)), stretches)
    line_first = np.cumsum(stretches) - stretches
    cut = first[owner] + 255 * (np.arange(len(owner)) - line_first[owner])
    bits = np.zeros((len(many), 32), np.uint8)
    for k in range(8):
        sums = np.add.reduceat((hashed >> np.uint32(k)) & np.uint32(0x01010101), cut, dtype=np.uint32)
        bits[:, k::8] = 2 * np.add.reduceat(sums.view(np.uint8).reshape(-1, 4).astype(np.int32), line_first, axis=0) > many[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint32).ravel()


def _distinct(hashed: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's grams once, so that frequent syllables don't make all lines of a language alike."""
    found = np.unique(np.repeat(np.arange(len(many), dtype=np.uint64), many) << np.uint64(32) | hashed)
    many = np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=len(many))
    return found.astype(np.uint32), np.cumsum(many) - many, many


def wide_simhash(lines: Lines, least: int = LEAST) -> np.ndarray:
    """(lines, 2 * WORDS) of 64 bits, by short and by long grams; 0 where a line is too short or too long to be asked for them."""
    out = np.zeros((len(lines.size), 4 * WORDS), np.uint32)
    for way, (gram, raw) in enumerate(zip(WIDE_GRAMS, gram_hashes(lines.points, WIDE_GRAMS))):
        full = np.flatnonzero((lines.size >= gram) & ((lines.size * 100 >= LONG * least) if way else (lines.size < LONG)))
        if not len(full):
            continue
        hashed, first, many = _distinct(*grams(raw, lines.start[full], lines.size[full], gram, WIDE_SAMPLED))
        for k in range(2 * WORDS):
            hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(k + 1)
            out[full, 2 * WORDS * way + k] = plain_simhash(hashed ^ (hashed >> np.uint32(13)), first, many)
    return out.view(np.int64)


def steep_blocks(hashed: np.ndarray, first: np.ndarray, seed: int = 5) -> np.ndarray:
    """(lines, BLOCKS): of each block's order the first gram's 16 bits."""
    rng = np.random.default_rng(seed)
    out = np.empty((BLOCKS, len(first)), np.uint32)
    for k, (factor, shift) in enumerate(rng.integers(0, 1 << 32, (BLOCKS // 2, 2), dtype=np.uint64).astype(np.uint32)):
        order = hashed * (factor | np.uint32(1))
        order ^= order >> np.uint32(16)
        order *= np.uint32(0x7FEB352D)
        order += shift
        np.minimum.reduceat(order, first, out=out[2 * k])
        np.maximum.reduceat(order, first, out=out[2 * k + 1])
    out *= np.uint32(0x9E3779B1)
    return (out >> np.uint32(16)).astype(np.uint16).T


def with_partner(group: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """Which rows, sorted by group and size, have another in their group that lengths leave it open to be alike."""
    near = (group[1:] == group[:-1]) & (size[:-1].astype(np.int64) * 100 >= size[1:].astype(np.int64) * least)
    out = np.zeros(len(group), bool)
    out[1:] |= near
    out[:-1] |= near
    return out


def tables() -> list[list[int]]:
    """The twenty lines of the affine plane over the field of four elements, as blocks."""
    times = np.zeros((4, 4), int)
    for a in range(4):
        for b in range(4):
            product = a * (b & 1) ^ a * (b & 2)
            times[a, b] = product ^ 7 if product > 3 else product
    slopes = [[4 * x + (int(times[m, x]) ^ c) for x in range(4)] for m in range(4) for c in range(4)]
    return slopes + [[4 * x + y for y in range(4)] for x in range(4)]


def table_keys(found: np.ndarray, way: np.ndarray) -> np.ndarray:
    """(tables, lines): the 64-bit value of each table, with the lowest bit of its upper half clear; way: by which grams a line is hashed."""
    out = np.empty((len(tables()), len(found)), np.uint64)
    for t, chosen in enumerate(tables()):
        value = np.zeros(len(found), np.uint64)
        for b in chosen:
            value = value << np.uint64(16) | found[:, b].astype(np.uint64)
        out[t] = mix(mix(value) + way * np.uint64(len(tables())) + np.uint64(t))
    return out & ~np.uint64(1 << 32)


def form_keys(points: np.ndarray, size: int) -> np.ndarray:
    """(forms, lines): values of lines of ``size`` characters and of their forms with one left out; the lowest bit of the upper half is set."""
    place = np.arange(size, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    whole = np.zeros(len(points), np.uint64)
    out = []
    for left in [None, *range(size)]:
        whole = np.zeros(len(points), np.uint64)
        rest = [k for k in range(size) if k != left]
        for j, k in enumerate(rest):
            whole += mix(points[:, k].astype(np.uint64) + place[j])
        out.append(mix(whole + np.uint64(len(rest))))
    return np.array(out) | np.uint64(1 << 32)


def _packed(part: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if len(part) and int(part.max()) < 1 << 16:
        part = part.astype(np.uint16)  # numpy sorts these by counting
    order = np.argsort(part, kind="stable")
    part, records = part[order].astype(np.int64), records[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        yield int(part[a]), records[a:b].tobytes()


def _classes_of(batches: Iterator[pa.RecordBatch], parts: int, least: int) -> Iterator[pa.RecordBatch]:
    """part, full, short: the records of lines, once each as far as the task sees; as many parts as the next stage has partitions."""
    share = 100 - least
    held: list[list[np.ndarray]] = [[], []]

    def handed() -> Iterator[pa.RecordBatch]:
        for k, kind in enumerate((FULL, SHORT)):
            if held[k]:
                records = np.concatenate(held[k])
                records = _once(records)
                rows = list(_packed((records["name"] % np.uint64(parts)).astype(np.int64), records))
                names, data = [p for p, _ in rows], [d for _, d in rows]
                empty = [b""] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(empty if k else data, pa.binary()), pa.array(data if k else empty, pa.binary())], names=["part", "full", "short"])
                held[k].clear()

    count = 0
    for piece in pieces(batches, most=1 << 20):
        lines = Lines([t or "" for t in piece.column("text").to_pylist()])
        digest, size = lines.digests(), lines.size
        # two edits are allowed from 200 / share characters of the longer line on
        full, single = np.flatnonzero(size * share * 100 >= 200 * least), np.flatnonzero((size * share < 200) & ((size + 1) * share >= 100))
        longest = [*(low for low, _ in GRAMS[1:]), 1 << 40]
        for way, ((low, gram), most, raw) in enumerate(zip(GRAMS, longest, gram_hashes(lines.points, [g for _, g in GRAMS]))):
            # lines near a border are hashed both ways
            own = full[(size[full] >= max(gram, low * least // 100)) & (size[full] * least < most * 100)]
            if len(own):
                hashed, first, many = grams(raw, lines.start[own], size[own], gram, SAMPLED)
                records = np.zeros(len(own), FULL)
                records["name"], records["rest"] = digest[own].T
                records["way"], records["size"], records["blocks"] = way, size[own], steep_blocks(hashed, first)
                held[0].append(records)
        if len(single):
            records = np.zeros(len(single), SHORT)
            records["name"], records["rest"] = digest[single].T
            records["size"] = size[single]
            at = np.minimum(lines.start[single][:, None] + np.arange(SHORT["points"].shape[0]), len(lines.points) - 1)
            records["points"] = lines.points[at]
            held[1].append(records)
        count += len(full) + len(single)
        if count >= RECORDS:
            yield from handed()
            count = 0
    yield from handed()


def _once(records: np.ndarray) -> np.ndarray:
    """Each class once for each way, in the order of their digests."""
    order = np.lexsort((records["way"], records["rest"], records["name"]))
    name, rest, way = (records[c][order] for c in ("name", "rest", "way"))
    new = np.ones(len(order), bool)
    new[1:] = (name[1:] != name[:-1]) | (rest[1:] != rest[:-1]) | (way[1:] != way[:-1])
    return records[order[new]]


def _entries_of(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """part, entries, members: what each class has in each table; members of hot values go as (bucket, entry) and leave one mark."""
    held: list[list[bytes]] = [[], []]
    for batch in batches:
        for k, name in enumerate(("full", "short")):
            held[k] += [x for x in batch.column(name).to_pylist() if x]
    full, short = (_once(np.frombuffer(b"".join(rows), kind)) for rows, kind in zip(held, (FULL, SHORT)))
    found: list[tuple[np.ndarray, np.ndarray]] = [(keys, full) for keys in (table_keys(full["blocks"], full["way"].astype(np.uint64)) if len(full) else ())]
    for size in np.unique(short["size"]).tolist():
        own = short[short["size"] == size]
        # a character of a run leaves the same form whichever of them it is
        keys = np.sort(form_keys(own["points"], size), axis=0)
        fresh = np.ones(keys.shape, bool)
        fresh[1:] = keys[1:] != keys[:-1]
        found += [(k[new], own[new]) for k, new in zip(keys, fresh)]
    if not found:
        return
    key = np.concatenate([k for k, _ in found])
    entries = np.zeros(len(key), ENTRY)
    entries["key"] = key >> np.uint64(32)
    entries["size"], entries["name"] = (np.concatenate([r[c] for _, r in found]) for c in ("size", "name"))
    # values are counted where more than HOT share their upper bits
    part = (key % np.uint64(parts)).astype(np.int64)
    slot = (key >> np.uint64(44)).astype(np.int64)
    hot = (np.bincount(slot) > HOT)[slot]
    values, times = np.unique(key[hot], return_counts=True)
    values = values[times > HOT]
    hot[hot] = np.isin(key[hot], values)
    cold = [(p, d, b"") for p, d in _packed(part[~hot], entries[~hot])]
    if len(values):
        marked = np.zeros(len(values), ENTRY)
        marked["key"], marked["size"] = values >> np.uint64(32), MARK
        cold += [(p, d, b"") for p, d in _packed((values % np.uint64(parts)).astype(np.int64), marked)]
        rows = np.zeros(int(hot.sum()), np.dtype([("bucket", "<u8"), ("entry", ENTRY)]))
        rows["bucket"], rows["entry"] = bucket_of(entries["key"][hot], part[hot]), entries[hot]
        cold += [(p, b"", d) for p, d in _packed((rows["entry"]["name"] % np.uint64(parts)).astype(np.int64), rows)]
    for a in range(0, len(cold), 256):
        out, data, members = zip(*cold[a : a + 256])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(data, pa.binary()), pa.array(members, pa.binary())], names=["part", "entries", "members"])


def bucket_of(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    return key.astype(np.uint64) << np.uint64(32) | part.astype(np.uint64)


def _members_of(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """bucket, node, size of the classes that have a possible partner in a bucket, and of all in hot buckets."""
    held, part, passed = [], [], []
    for batch in batches:
        for p, entries, members in zip(*(batch.column(c).to_pylist() for c in ("part", "entries", "members"))):
            if members:
                passed.append(members)
            else:
                held.append(np.frombuffer(entries, ENTRY)), part.append(np.full(len(entries) // ENTRY.itemsize, p, np.uint64))

    def rows(bucket: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(np.ascontiguousarray(entries["name"]).view(np.int64)), pa.array(entries["size"].astype(np.int64))], names=["bucket", "node", "size"])

    for raw in passed:
        own = np.frombuffer(raw, np.dtype([("bucket", "<u8"), ("entry", ENTRY)]))
        yield rows(np.ascontiguousarray(own["bucket"]), own["entry"])
    if not held:
        return
    entries = np.concatenate(held)
    bucket = bucket_of(entries["key"], np.concatenate(part))
    order = np.argsort(bucket)
    bucket = bucket[order]
    same = bucket[1:] == bucket[:-1]
    several = np.append(False, same) | np.append(same, False)
    bucket, entries = bucket[several], entries[order[several]]
    order = np.lexsort((entries["size"], bucket))
    bucket, entries = bucket[order], entries[order]
    mark = (entries["name"] == 0) & (entries["size"] == MARK)
    kept = with_partner(bucket, entries["size"], least) | np.isin(bucket, bucket[mark])
    kept &= ~mark
    yield rows(bucket[kept], entries[kept])


def _lines_of(docs: DataFrame, texts: bool) -> DataFrame:
    """Of every line that isn't empty doc_id, text_hash, pos, node, rest; with ``texts`` node and line instead, once for each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, most=1 << 20):
            lines = Lines([t or "" for t in part.column("text").to_pylist()])
            digest = lines.digests()
            if texts:
                _, first = np.unique(digest[:, 0], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(digest[first, 0].view(np.int64)), pa.array(lines.strings(first), pa.string())], names=["node", "line"])
            else:
                at, named = pa.array(lines.text), [pa.array(np.ascontiguousarray(digest[:, k]).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(lines.number.astype(np.int32)), *named], names=["doc_id", "text_hash", "pos", "node", "rest"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.col("text") != "")
    return map_arrow(rows, run, "node long, line string" if texts else f"doc_id {id_type}, text_hash long, pos int, node long, rest long")


def _with_partners(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and size those that have a possible partner in their bucket, which is named by who they are: equal sets get one name."""
    for batch, starts in whole_groups(batches, "bucket"):
        bucket, node, size = (batch.column(c).to_numpy() for c in ("bucket", "node", "size"))
        kept, hashed = with_partner(bucket, size, least), mix(node.view(np.uint64))
        hashed[~kept] = 0
        who = mix(np.bitwise_xor.reduceat(hashed, starts[:-1]) + np.add.reduceat(kept, starts[:-1], dtype=np.uint64))
        named = pa.array(np.repeat(who, np.diff(starts)).view(np.int64))
        yield pa.RecordBatch.from_arrays([named, *batch.columns[1:]], names=batch.schema.names).filter(pa.array(kept))


def _maybe_broadcast(df: DataFrame, rows: int = SMALL_TABLE) -> DataFrame:
    """Marked for broadcast if it has few rows; a shuffle joins it otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _alike_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = pa.array(alike(batch.column("p").to_pylist(), batch.column("q").to_pylist(), least))
        yield batch.select(["a", "b"]).filter(same)


def _shared_grams(lines: list[str], gram: int) -> np.ndarray:
    """(lines, lines): how many grams two lines share at least as many times as counted; never fewer than they do."""
    found = Lines(lines)
    many = np.maximum(found.size - gram + 1, 0)
    owner = np.repeat(np.arange(len(lines)), many)
    raw = next(gram_hashes(found.points, [gram]))[np.repeat(found.start - np.cumsum(many) + many, many) + np.arange(many.sum())]
    pair = np.sort(raw.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64))
    # a gram's first, second, ... occurrence in a line are columns of their own, so that products of rows count repeats
    first = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
    times = np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))
    order = np.lexsort((times, pair >> np.uint64(32)))
    pair, times = pair[order], times[order]
    hashed = pair >> np.uint64(32)
    column = np.cumsum(np.append(False, (hashed[1:] != hashed[:-1]) | (times[1:] != times[:-1]))[: len(pair)])
    lines_of = np.bincount(column)
    out = np.full((len(lines), len(lines)), np.count_nonzero(lines_of == len(lines)), np.float32)
    some = ((lines_of > 1) & (lines_of < len(lines)))[column]
    row, column = (pair[some] & np.uint64(0xFFFFFFFF)).astype(np.int64), column[some]
    column = np.cumsum(np.append(False, column[1:] != column[:-1])[: len(column)])
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        at, to = np.searchsorted(column, [low, low + 4096])
        ones = np.zeros((len(lines), min(4096, int(column[-1]) + 1 - low)), np.float32)
        ones[row[at:to], column[at:to] - low] = 1
        out += ones @ ones.T
    return out


def _left_open(lines: list[str], pairs: np.ndarray, least: int) -> np.ndarray:
    """Of the ``pairs`` (lines, lines) those that may be alike, by bounds that every alike pair keeps.

    An edit takes at most g of the longer line's grams of g characters, so alike lines share all others.
    """
    own = np.flatnonzero(pairs.any(0) | pairs.any(1))
    size = np.fromiter((len(lines[k]) for k in own), np.int64, len(own))
    longer = np.maximum(size[:, None], size)
    edits = allowed(longer, least)
    left = pairs[np.ix_(own, own)] & (longer - np.minimum(size[:, None], size) <= edits)
    for gram in COUNTED:
        if left.any():
            left &= _shared_grams([lines[k] for k in own], gram) >= longer - gram + 1 - gram * edits
    out = np.zeros(pairs.shape, bool)
    out[np.ix_(own, own)] = left
    return out


def _linked_within(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """For each task the links that connect what is alike in it.

    Every pair is compared but those that are connected already and those that a bound on the edits rules out.
    """
    for batch, starts in whole_groups(batches, "task"):
        nodes, comp, block, across = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "block", "across"))
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            lines = batch.column("line").slice(a, b - a).to_pylist()
            open_ = np.triu(np.ones((b - a, b - a), bool), 1)
            if across[a]:
                open_ &= block[a:b, None] != block[None, a:b]
            # what is in one component already has one label, and isn't compared again
            _, before, label = np.unique(comp[a:b], return_index=True, return_inverse=True)
            label, found_i, found_j = before[label], [np.arange(b - a)], [before[label]]
            open_ &= label[:, None] != label[None, :]
            i, j = np.nonzero(_left_open(lines, open_, least))
            # the nearest first, so that groups join early
            own, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            bits = wide_simhash(Lines([lines[k] for k in own]), least)[place] if len(own) else np.zeros((0, 1), np.int64)
            order = np.argsort(np.bitwise_count((bits[: len(i)] ^ bits[len(i) :]).view(np.uint64)).sum(1), kind="stable")
            i, j = i[order], j[order]
            while len(i):
                some = min(len(i), max(256, b - a))
                same = alike([lines[k] for k in i[:some]], [lines[k] for k in j[:some]], least)
                found_i.append(i[:some][same]), found_j.append(j[:some][same])
                label = local_components(b - a, np.concatenate(found_i), np.concatenate(found_j))
                i, j = i[some:], j[some:]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
            moved = np.flatnonzero(label != np.arange(b - a))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a:b][label[moved]]), pa.array(nodes[a:b][moved])], names=["a", "b"])


def candidates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """bucket, node, size: the classes of lines that share a bucket with a possible partner (a written table)."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = map_arrow(docs.select("text").where(F.col("text") != ""), lambda x: _classes_of(x, parts, least), "part int, full binary, short binary")
    entries = map_arrow(packed.repartitionById(parts, F.col("part")), lambda x: _entries_of(x, parts), "part int, entries binary, members binary")
    return written(map_arrow(entries.repartitionById(parts, F.col("part")), lambda x: _members_of(x, least), "bucket long, node long, size long"), "members")


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, gone: sorted numbers of the lines to remove from each text that loses any (a written table)."""
    if not 80 <= least <= 100:
        raise ValueError("an edit similarity from 80 to 100 percent is required")
    members, parts = candidates(docs, least), max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("bucket")
    large = _maybe_broadcast(written(large, "large"))
    dealt = members.join(large, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket", "size")
    near = map_arrow(dealt, lambda x: _with_partners(x, least), "bucket long, node long, size long").union(members.join(large, "bucket"))
    near = written(near.dropDuplicates(["bucket", "node"]).select("bucket", "node", F.struct("size").alias("f")), "near")
    drop_written(members)
    wanted = _maybe_broadcast(near.select("node").distinct())
    texts = written(_lines_of(docs, True).join(wanted, "node").dropDuplicates(["node"]), "texts")

    def possible(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
        return F.least(n, m) * 100 >= F.greatest(n, m) * least

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("node").alias("a"), F.col("line").alias("p")), texts.select(F.col("node").alias("b"), F.col("line").alias("q"))
        return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q"), lambda x: _alike_pairs(x, least), "a long, b long")

    def dense(rows: DataFrame) -> DataFrame:
        tasks = blocks(rows, "bucket", "node", BLOCK).select("task", "across", "block", "node", "comp").join(texts, "node")
        dealt = tasks.repartition(parts, "task").sortWithinPartitions("task")
        return map_arrow(dealt, lambda x: _linked_within(x, least), "a long, b long")

    comps = link_buckets(near, texts, possible, verify, dense=dense)
    drop_written(near, texts)
    every = written(_lines_of(docs, False), "occurrences")
    linked = _maybe_broadcast(comps.withColumnRenamed("node", "linked"))
    named = every.join(linked, F.col("node") == F.col("linked"), "left").select("doc_id", "text_hash", "pos", F.coalesce("comp", "node").alias("group"), F.when(F.col("comp").isNull(), F.col("rest")).otherwise(F.lit(0)).alias("side"), F.col("comp").isNotNull().alias("fuzzy"))
    group = ["group", "side", "fuzzy"]
    place = F.struct("doc_id", "text_hash", "pos")
    repeated = written(named.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    own = written(named.join(_maybe_broadcast(repeated), group), "own")
    keepers = own.groupBy(*group).agg(F.min(place).alias("keep"))
    losing = own.join(_maybe_broadcast(keepers), group).where(~place.eqNullSafe(F.col("keep")))
    out = written(losing.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone")
    drop_written(every, comps, repeated, own)
    return out


def without_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated lines taken out of ``text``, and n_lines, n_removed."""
    gone = _maybe_broadcast(repeated_lines(docs.select("doc_id", "text"), least))
    gone = gone.select(F.struct("doc_id", "text_hash").alias("key"), "gone")
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    rows = docs.select(F.struct(*rest).alias("row"), "text", F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("own"))
    joined = rows.join(gone, F.col("own.doc_id").eqNullSafe(F.col("key.doc_id")) & (F.col("own.text_hash") == F.col("key.text_hash")), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains(F.col("gone"), k)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text")
    counts = [F.coalesce(F.size(x), F.lit(0)).cast("long").alias(name) for x, name in ((lines, "n_lines"), (F.col("gone"), "n_removed"))]
    found = joined.select("row", text, *counts)
    return found.select(*("text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; a document all of whose text stood elsewhere goes, one that was empty before stays.

    A column n_chars follows the new text.
    """
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = without_repeated_lines(packed).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = []
    for field in docs.schema:
        value = F.col("text") if field.name == "text" else F.col("row")[field.name]
        if field.name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(value).cast(field.dataType)
        columns.append(value.alias(field.name))
    return found.select(*columns)
