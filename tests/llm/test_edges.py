"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: each operator's defined results."""

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewise.llm import bpe, edits, graph, itq, langid, lines, lsh, minhash, mixing, shard, tokenfile, toxic

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, comp string"
LONG = "word" * 3000 + " " + "a b c d e f g " * 4000


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, 0.5, 1, "x") for i, t, s in rows], KINDS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null, empty, blank and long texts, a repeated row, ties, columns named as the operators' own."""
    rows = [(1, None, "a"), (2, "", None), (3, "  \n\t", "b"), (4, LONG, "a"), (5, "one two three", "b"), (5, "one two three", "b"), (6, "one two three", "c"), (None, "x y", "c"), (7, "12 34 .", "a"), (8, "Él está aquí\nEl perro come pan todos los días\nel PERRO come: pan, todos los días!", "a")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}
    assert graph.components(edges.limit(0)).collect() == []
    more = graph.merged(graph.components(edges), spark.createDataFrame([(40, 100), (500, 600)], "a long, b long"))
    assert {r["node"]: r["comp"] for r in more.collect()} == {k: 1 for k in [*range(1, 41), 100, 101]} | {500: 500, 600: 500}


def test_language(spark, odd, none):
    got = langid.held_out_prediction(odd).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 7)} == {"und"}
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert langid.held_out_prediction(none).count() == 0
    assert {r["lang_pred"] for r in langid.held_out_prediction(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 5, 6, 8]


def test_nothing_to_learn_keeps_what_has_letters(spark, odd):
    kept = langid.keep_identified(odd.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 5, 6, 8]


def test_bpe(spark, odd, none):
    ranks = bpe.SegmentTreeBPE.from_file(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    got = bpe.encode_decode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    rows = sorted(got.collect(), key=lambda r: (r["doc_id"] or 0))
    assert [r["ids"] for r in rows] == [own.encode_ordinary(t) for _, t in texts]
    assert [r["decoded_sha256"] for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for _, t in texts]
    assert bpe.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, False).count() == 0
    strange = ["a" * 700, "\x85  x\x1c\x1d", "日本語🙂🙂 don't", "é" * 99, "́‍  "]
    assert list(ranks.encode_many(strange)) == [own.encode_ordinary(t) for t in strange]


def test_near_duplicates(spark, odd, none):
    got = minhash.near_duplicates(odd, 4).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and (by[1]["n_shingles"], by[2]["n_shingles"], by[3]["n_shingles"], by[5]["n_shingles"]) == (0, 0, 0, 1)
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[5]["kept"] and by[1]["kept"] and by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    once = odd.dropDuplicates(["doc_id"])
    assert sorted(r["doc_id"] or 0 for r in minhash.keep_one(once).collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_linking_writes_only_tables_that_are_read_again(spark, monkeypatch):
    # on a local store every file costs three processes, in each of which the tool may count the executor's memory once more
    names, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or write(df, name))
    members = spark.createDataFrame([(k, k // 2 * 10, (5,)) for k in range(8)] + [(k, 7, (5,)) for k in range(0, 8, 3)], "node long, bucket long, f struct<size: long>")
    comps = graph.link_buckets(members, members, lambda x, y: F.lit(True), lambda pairs: pairs.where("b - a = 3 or b = a + 1"))
    assert {r["node"]: r["comp"] for r in comps.collect()} == {k: 4 if k in (4, 5) else 0 for k in range(8)}
    assert sorted(names) == ["central", "components", "components", "components", "edges", "edges", "grouped", "open-rows", "shared"]


def test_crowded_bucket(spark):
    """A group of edited copies, most pairs of which aren't similar enough: the same components as by brute force."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(160):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(2, 7)), replace=False):
            words[k] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(words))
    docs = table(spark, [(k + 1, t, "a") for k, t in enumerate(texts)])
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    up = list(range(160))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(160):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 4).collect()}
    assert got == {k + 1: find(k) + 1 for k in range(160)}


def test_lines(spark, odd, none):
    got = lines.without_repeated_lines(odd.select("doc_id", "text", F.lit(9).alias("n_lines")))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[8]["text"] == "Él está aquí\nEl perro come pan todos los días" and by[8]["n_removed"] == 1
    assert by[1]["text"] is None and by[1]["n_lines"] == 0 and by[4]["n_removed"] == 0 and got.count() == 10
    assert lines.without_repeated_lines(none).count() == 0
    kept = lines.dedup_lines(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").first()["n_chars"] == len(by[8]["text"])
    twice = table(spark, [(1, "this line stands in two documents\nfirst", "a"), (2, "this line stands in two documents", "a"), (3, "", "a")])
    assert sorted(r["doc_id"] for r in lines.dedup_lines(twice).collect()) == [1, 3]


def test_fuzzy_lines(spark):
    """Edited lines: the same groups as by comparing all pairs by edit similarity."""
    rng = np.random.default_rng(4)
    texts = []
    for k in range(30):
        words = [f"{'abcdefgh'[k % 8]}{'xyz'[w % 3]}ord{w}{'ghijk'[k % 5]}" for w in range(40)]
        for c in range(3):
            edited = list(words)
            for w in rng.choice(40, c, replace=False):
                edited[w] = edited[w][::-1]
            texts.append(" ".join(edited).replace("0", "o").replace("1", "i"))
    clean = [lines.normalised(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if clean[i] == clean[j] or 10 * distance(clean[i], clean[j]) <= max(len(clean[i]), len(clean[j])):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert len({find(k) for k in range(len(texts))}) < len(texts) - 5
    got = {r["doc_id"]: r["n_removed"] for r in lines.without_repeated_lines(table(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()}
    assert got == {k: int(find(k) != k) for k in range(len(texts))}


def distance(a, b):
    before = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        now = np.concatenate([[i], np.minimum(before[1:] + 1, before[:-1] + (np.array(list(b)) != x))])
        before = np.minimum.accumulate(now - np.arange(len(now))) + np.arange(len(now))
    return before[-1]


def test_fuzzy_lines_recall(spark):
    """Of all pairs of an edit similarity of 0.9 or more, whatever their hashes, nearly all are found."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = []
    for k in range(120):
        words = ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range((8, 16, 30, 60)[k % 4])]
        changed, replaced = list(" ".join(words)), list(words)
        changed[rng.integers(len(changed))] = "q"
        for w in rng.choice(len(words), len(words) // 16, replace=False):
            replaced[w] = "".join(rng.permutation(list(words[w])))
        texts += [" ".join(words), "".join(changed), " ".join(replaced)]
    clean = [lines.normalised(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 10 * abs(len(clean[i]) - len(clean[j])) <= len(clean[j]) and set(clean[i].split()) & set(clean[j].split()) and 10 * distance(clean[i], clean[j]) <= max(len(clean[i]), len(clean[j]))]
    later = {j for _, j in pairs}
    assert len(later) > 200
    got = {r["doc_id"]: r["n_removed"] for r in lines.without_repeated_lines(table(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()}
    assert {k for k, n in got.items() if n} <= later and sum(got[k] for k in later) >= 0.98 * len(later)


def test_edit_similarity_equals_the_full_table():
    rng = np.random.default_rng(2)
    left, right = [], []
    for size in rng.choice([0, 1, 2, 5, 9, 10, 11, 19, 20, 30, 60, 100], 400).tolist():
        a = list(rng.choice(list("abcd"), size))
        b = list(a)
        for _ in range(int(rng.integers(0, max(1, size // 6) + 1))):
            at, kind = int(rng.integers(0, len(b) + 1)), rng.integers(3)
            b[at : at + (kind < 2)] = [str(rng.choice(list("abcd\u00e9\U0001f642")))] if kind else []
        left.append("".join(a)), right.append("".join(b))
    for least in (80, 90, 95):
        true = [100 * distance(a, b) <= (100 - least) * max(len(a), len(b)) if b else 100 * len(a) <= (100 - least) * len(a) for a, b in zip(left, right)]
        assert edits.alike(left, right, least).tolist() == true


def edited(rng, line, letters, many):
    """The line after so many edits, not all of which need to count."""
    out = list(line)
    for at, kind in zip(rng.integers(0, len(out), many).tolist(), rng.integers(0, 3, many).tolist()):
        at = min(at, len(out))
        out[at : at + (kind < 2)] = [str(rng.choice(letters))] if kind else []
    return "".join(out)


def test_edit_similarity_of_long_lines_equals_the_full_table(monkeypatch):
    """Bands of one and of several words, with runs that carry from word to word, and the band of any length."""
    rng = np.random.default_rng(4)
    letters = list("abcdefgh\u00e9\U0001f642")
    left, right = ["", "a", ""], ["", "", ""]
    for size in [250, 630, 645] * 4:
        a = "".join(rng.choice(letters, size))
        left.append(a), right.append(edited(rng, a, letters, int(size * rng.choice([0.02, 0.11, 0.13, 0.16]))))
    for a, b in (("a" * 400, "a" * 330 + "b" * 40), ("a" * 500, "b" * 30 + "a" * 420), ("a" * 200 + "b" * 300, "a" * 140 + "b" * 310), ("ab" * 200, "ba" * 200)):
        left.append(a), right.append(b)
    far = [distance(a, b) for a, b in zip(left, right)]
    for least in (50, 80, 90):
        true = [100 * d <= (100 - least) * max(len(a), len(b)) for d, a, b in zip(far, left, right)]
        assert edits.alike(left, right, least).tolist() == true and edits.alike(right, left, least).tolist() == true
        assert edits.alike(left[:1], right[:1], least).all()
    monkeypatch.setattr(edits, "WORDS", 0)
    assert edits.alike(left, right, 50).tolist() == [100 * d <= 50 * max(len(a), len(b)) for d, a, b in zip(far, left, right)]


def test_edit_similarity_takes_little_time_a_pair():
    """CPU time of 1,000 pairs of 500 characters near the threshold, in that of a loop of plain Python (about 1 ms)."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    left = ["".join(rng.choice(letters, 500)) for _ in range(1000)]
    right = [edited(rng, a, letters, 60) for a in left]

    def took(call):
        begin = time.thread_time()
        call()
        return time.thread_time() - begin

    unit = sorted(took(lambda: sum(range(50_000))) for _ in range(99))[49]
    spent = min(took(lambda: edits.alike(left, right, 90)) for _ in range(3)) / unit
    assert spent < 120, spent


def test_hot_values_and_crowded_buckets_of_lines(spark):
    """A group of thousands of edited copies of a line, whose buckets are hot: one line stays, and others are left alone."""
    rng = np.random.default_rng(6)
    base = [f"{a}{b}rim{b}{a}" for a in "bcdfghkl" for b in "aeiou"]
    texts = []
    for k in range(3000):
        words = list(base)
        for w in rng.choice(40, 1 + k % 3, replace=False):
            words[w] = "".join(rng.permutation(list("qwertzu")))[:6]
        texts.append(" ".join(words))
    other = ["".join(rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))) + " " + "".join(rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))) for _ in range(300)]
    docs = table(spark, [(k, t, "a") for k, t in enumerate(texts + other)])
    hot, lines.HOT = lines.HOT, 2
    try:
        got = {r["doc_id"]: r["n_removed"] for r in lines.without_repeated_lines(docs).collect()}
    finally:
        lines.HOT = hot
    assert got == {k: int(0 < k < 3000) for k in range(3300)}


def crowded_task(seed, many):
    """Copies of one line that differ by two edited stretches: the first is that of one of three versions, the second their own."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    base = rng.choice(letters, 200)
    versions = [base.copy() for _ in range(3)]
    for version in versions:
        version[20:26] = rng.choice(letters, 6)
    out = []
    for k in range(many):
        line = versions[k % 3].copy()
        at = int(rng.integers(30, 180))
        line[at : at + 8] = rng.choice(letters, 8)
        out.append("".join(line))
    return out


def linked(texts):
    """The smallest number that each text reaches by pairs of an edit similarity of 0.9 or more."""
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 10 * distance(texts[i], texts[j]) <= max(len(texts[i]), len(texts[j]))]
    i, j = np.array(pairs, np.int64).reshape(-1, 2).T
    return graph.local_components(len(texts), i, j)


def test_crowded_buckets_of_lines_miss_no_pair():
    """In a crowded bucket pairs that share nothing but the bucket's common text are compared too."""
    texts = crowded_task(1, 40)
    features = lines.wide_simhash(lines.Lines(texts))
    batch = pa.RecordBatch.from_pydict(
        {"task": [1] * 40, "across": [False] * 40, "block": [0] * 40, "node": list(range(40)), "comp": list(range(40)), "size": np.array([len(t) for t in texts], np.int32), "line": texts}
        | {b: features[:, k] for k, b in enumerate(lines.BITS)}
    )
    (got,) = lines._linked_within(iter([batch]), 90)
    label = graph.local_components(40, got.column("a").to_numpy(), got.column("b").to_numpy())
    want = linked(texts)
    assert (want == 0).sum() > 20 and label.tolist() == want.tolist()


def test_blocks_of_crowded_buckets_of_lines_miss_no_pair_across():
    """The pipeline's line dedup too: where two blocks of a bucket meet, every pair across them is compared."""
    texts = crowded_task(2, 40)
    features = lines.wide_simhash(lines.Lines(texts))
    block = np.arange(40) % 2
    batch = pa.RecordBatch.from_pydict(
        {"task": [1] * 40, "across": [True] * 40, "block": block, "node": list(range(40)), "comp": list(range(40)), "size": np.array([len(t) for t in texts], np.int32), "line": texts}
        | {b: features[:, k] for k, b in enumerate(lines.BITS)}
    )
    (got,) = lines._linked_within(iter([batch]), 90)
    label = graph.local_components(40, got.column("a").to_numpy(), got.column("b").to_numpy())
    pairs = [(i, j) for j in range(40) for i in range(j) if block[i] != block[j] and 10 * distance(texts[i], texts[j]) <= max(len(texts[i]), len(texts[j]))]
    i, j = np.array(pairs).T
    assert len(pairs) > 50 and label.tolist() == graph.local_components(40, i, j).tolist()


def table_values(texts):
    """The values of each text, of 20 to 99 characters, in the tables of the line operator."""
    found = lines.Lines(texts)
    raw = next(lines.gram_hashes(found.points, [lines.GRAMS[0][1]]))
    hashed, first, _ = lines.grams(raw, found.start, found.size, lines.GRAMS[0][1], lines.SAMPLED)
    return [set(own) for own in lines.table_keys(lines.steep_blocks(hashed, first), np.zeros(len(texts), np.uint64)).T.tolist()]


def test_lines_that_share_a_table_miss_no_pair(spark):
    """Whatever their SimHashes: lines that a table brings together are removed if they are alike by edit similarity."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = []
    for _ in range(4000):
        line = rng.choice(letters, 60)
        # a stretch that repeats has few grams, so that edits elsewhere weigh much in a SimHash
        line[:40] = np.tile(line[:10], 4)
        edited = line.copy()
        edited[rng.choice(np.arange(40, 60), 6, replace=False)] = rng.choice(letters, 6)
        texts += ["".join(line), "".join(edited)]
    values = table_values(texts)
    want = {k: int(k % 2 and bool(values[k] & values[k - 1])) for k in range(len(texts))}
    assert all(10 * distance(texts[k - 1], texts[k]) <= 60 for k in want if want[k]) and sum(want.values()) > 500
    got = {r["doc_id"]: r["n_removed"] for r in lines.without_repeated_lines(table(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()}
    assert got == want


def test_lines_beside_columns_of_any_name(spark, odd):
    docs = odd.select("*", *(F.lit(1).alias(c) for c in ("_id", "_gone", "row", "gone", "own", "key", "node", "text_hash")))
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r["doc_id"] or 0 for r in lines.dedup_lines(odd).collect())


def test_short_lines(spark):
    """Exact repeats of any length go; fuzzy ones by characters, so scripts without blanks and short lines take part."""
    han = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    texts = ["Home\nContact us\nright", "home!\ncontact us\nother", han, han[:30] + "\u4e01" + han[31:], "footer navi", "footer nav", "right"]
    docs = table(spark, [(k, t, "a") for k, t in enumerate(texts)])
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.without_repeated_lines(docs).collect()}
    assert got == {0: (texts[0], 0), 1: ("other", 2), 2: (han, 0), 3: ("", 1), 4: ("footer navi", 0), 5: ("", 1), 6: ("", 1)}


def test_copies_of_paragraphs_parted_by_blank_lines_go(spark):
    text = "a first paragraph of some words\n\nand a second one of others\n\r\n\t\nthe third ends the document here"
    docs = table(spark, [(1, text, "a"), (2, text, "a"), (3, " \n\t", "a")])
    assert sorted(r["doc_id"] for r in lines.dedup_lines(docs).collect()) == [1, 3]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], 1), (10, [], 0), (11, [1.0], 0), (3, [1.0, 0.0], 0)]
    kinds = "vec_id long, embedding array<float>, label int"
    got = sorted(tuple(r) for r in itq.near_vectors(spark.createDataFrame(rows, kinds)).collect())
    linked = {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False)}
    assert got == sorted((k, *linked.get(k, (0, k, True))) for k, *_ in rows)
    assert itq.near_vectors(spark.createDataFrame([], kinds)).count() == 0
    near = lsh.nearest(spark.createDataFrame([*rows, (50, [1.0, 0.0], 0), (100, [0.0, 1.0], 0)], kinds), F.col("vec_id") % 50 == 0, 3)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in near.orderBy("query_id", "rank").collect()] == [(50, 1, 1), (50, 2, 3), (50, 3, 4), (100, 1, 2), (100, 2, 1), (100, 3, 3)]
    assert lsh.nearest(spark.createDataFrame([], kinds), F.col("vec_id") % 50 == 0).count() == 0
    assert lsh.nearest(spark.createDataFrame([(50, [1.0, 0.0], 0)], kinds), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_leave_other_ids_of_their_vector(spark):
    rows = [*[(1, [1.0, 0.0], 0)] * 4, (2, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [0.0, 1.0], 0), (50, [1.0, 0.0], 0)]
    near = lsh.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 50 == 0, 2)
    assert [(r["rank"], r["vec_id"]) for r in near.orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_itq_and_lsh_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 32))
    near = base[:400] / np.linalg.norm(base[:400], axis=1, keepdims=True) + rng.normal(size=(400, 32)) * 0.06
    every = np.concatenate([base, near]).astype(np.float32)
    docs = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(every)], "vec_id long, embedding array<float>, label int")
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    cosine = unit @ unit.T
    label = np.arange(len(every)) % 3
    links = (cosine >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r["n_links"] for r in itq.near_vectors(docs).collect()}
    true = links.sum(1)
    assert true.sum() > 50 and all(got[k] <= true[k] for k in got) and sum(got.values()) >= 0.95 * true.sum()
    np.fill_diagonal(cosine, -2)
    best = {k: set(np.argsort(-cosine[k])[:5].tolist()) for k in range(0, len(every), 50)}
    found = lsh.nearest(docs, F.col("vec_id") % 50 == 0).collect()
    assert sum(r["vec_id"] in best[r["query_id"]] for r in found) >= 0.9 * 5 * len(best)
    assert all(abs(r["score"] - cosine[r["query_id"], r["vec_id"]]) < 1e-12 for r in found)


def _planted(rng, rows, size, copies, offset=0.0):
    """Unit vectors about a common offset, and of the first ``copies`` of them others at a cosine of 0.94 to 0.99."""
    base = rng.normal(size=(rows, size)) + offset
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=(copies, size))
    aside -= (aside * base[:copies]).sum(1, keepdims=True) * base[:copies]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.94, 0.99, (copies, 1))
    return np.concatenate([base, cosine * base[:copies] + np.sqrt(1 - cosine**2) * aside])


def test_planted_links_in_a_label_of_thousands(spark):
    """Coded path: at least 0.99 of the links that comparing all pairs finds, and none that it doesn't."""
    vectors = _planted(np.random.default_rng(5), 5000, 48, 600).astype(np.float32)
    docs = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.93
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r for r in itq.near_vectors(docs).collect()}
    true = links.sum(1)
    assert true.sum() >= 1200 and all(got[k]["n_links"] <= true[k] for k in got) and sum(r["n_links"] for r in got.values()) >= 0.99 * true.sum()
    assert sum(got[5000 + k]["component_id"] == k and not got[5000 + k]["kept"] for k in range(600)) >= 594


def test_codes_are_balanced_on_concentrated_vectors():
    rng = np.random.default_rng(7)
    unit = _planted(rng, 8000, 64, 0, offset=0.5)
    codes = itq.learn(unit, [0] * len(unit), len(unit), 0.93)
    signs = codes.signs(unit, [0] * len(unit))
    assert 0.45 < signs.mean(0).min() and signs.mean(0).max() < 0.55
    for t in range(min(codes.tables, 10)):
        assert np.bincount(codes.substrings(signs)[:, t]).max() <= 4 * len(unit) / 2**codes.bits
    groups = rng.integers(0, 4, 8000)
    clusters = unit + 3 * rng.normal(size=(4, 64))[groups]
    clusters /= np.linalg.norm(clusters, axis=1, keepdims=True)
    codes = itq.learn(clusters, groups.tolist(), 2000, 0.93)
    signs = codes.signs(clusters, groups.tolist())
    assert all(0.4 < signs[groups == g].mean(0).min() and signs[groups == g].mean(0).max() < 0.6 for g in range(4))


def test_repeated_and_null_ids_of_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (None, [0.6, -0.8], 0)]
    got = sorted(map(tuple, itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, 1, False), (None, 0, None, True)], key=str)


def test_shards(spark, odd, none):
    got = shard.sharded(odd, 4).collect()
    assert sorted(r["row"] for r in got) == list(range(10)) and {r["law"] for r in got} == {"rows"}
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}[1] == (1, 0)
    assert shard.sharded(none).count() == 0
    for n in (1, 2, 3, 10, 1000, 4097):
        there = shard.permute(np.arange(n), n, 5)
        assert sorted(there) == list(range(n)) and (shard.permute(there, n, 5, back=True) == np.arange(n)).all()


def test_token_files(spark, odd, none):
    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    start = 0
    got = {r["start"]: r for r in tokenfile.token_report(odd, path).collect()}
    for r in odd.orderBy(F.col("doc_id").asc_nulls_first()).collect():
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert (got[start]["doc_id"], got[start]["n_tokens"], got[start]["ids_crc32"]) == (r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.token_report(none, path).count() == 0
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7])
    for n in range(len(values) + 1):
        assert (tokenfile.decode(*tokenfile.encode(values[:n]), n) == values[:n]).all()
    # another session needs nothing but the folder
    place = tokenfile.write_tokens(odd, path)
    assert sorted(map(tuple, tokenfile.read_tokens(spark.newSession(), place).collect()), key=str) == sorted(map(tuple, got.values()), key=str)
    other = open(path).read().replace("|[\\\\p{N}]|", "|[\\\\p{N}]+|")
    assert other != open(path).read() and not tokenfile.WordEncoder(other).plain
    texts = ["12 345 a1b22", "It's 2024, x."]
    ids, _ = tokenfile.WordEncoder(other).encode_many(texts, 2)
    assert ids.tolist() == [i for t in texts for i in [*Tokenizer.from_str(other).encode(t, add_special_tokens=False).ids, 2]]
    encoder = tokenfile.WordEncoder(open(path).read())
    strange = ["A.B, c.. D., e.", "It's, I'LL. o'clock", "ΣΑΣ ΟΔΟΣ", "H̱ẖ é", "İ ı", "a\x1cb\x85c\xa0d e　f", "x,", ".\n,", "<|endoftext|>x, A<|endoftext|>.", "ª º ² ǅ"]
    ids, sizes = encoder.encode_many(strange, 2)
    assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == [*own.encode(strange[0]).ids, 2]
    assert ids.tolist() == [i for t in strange for i in [*own.encode(t, add_special_tokens=False).ids, 2]]


def test_words_that_end_in_marks_need_only_the_merging_model():
    path = P.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        encoder, whole = tokenfile.WordEncoder(file.read()), Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    marks = [*tokenfile.ENDING, "", "'s", "'", "\u2019", "\u00a0", "9"]
    words = ["".join([*rng.choice([*"abcdefghijklmnopqrstuvwxyz\u00e9\u00df\u03c3\u0438"], rng.integers(1, 9)), *rng.choice(marks, rng.integers(0, 5))]) for _ in range(4000)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)] + ["", "Stra\u00dfe!! \u039f\u0394\u039f\u03a3. e\u0301!!\t\n a$$$  b&&&", "\x0b.\x85x ... <s> word<|endoftext|>!! </w>."]
    ids, sizes = encoder.encode_many(texts, 2)
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    sent = []
    encoder.tokenizer = type("Watched", (), {"encode": lambda self, text, **k: sent.append(text) or whole.encode(text, **k)})()
    encoder.encode_many(["unmet$$$ words!! of/// letters&&& \u00e9t\u00e9***"], 2)
    assert not {*sent} - {"$$$", "!!", "///", "&&&", "***"}


def test_mixing(spark, odd, none):
    got = mixing.mix_plan(odd).collect()
    assert len(got) == 10 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_plan(none).count() == 0
    rows = mixing.mix_rows(odd)
    assert rows.columns == odd.columns and {1, 2, 3} <= {r["doc_id"] for r in rows.collect()}
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 10)], "source string, size long")
    target = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert target["a"] == 20 and target[None] == 20 and abs(sum(target.values()) - 1.5 * 2020) < 1e-6 and target["b"] / target["c"] == 2
    many = table(spark, [(k, "a b c d e", f"s{k % 4}") for k in range(4000)])
    taken = {}
    sized = many.select("doc_id", "source", F.lit(5).cast("long").alias("size"))
    for r in mixing.repeated(sized, mixing.mix_rates(sized)).groupBy("source").agg(F.sum(F.col("size") * F.col("repetitions")).alias("t"), F.first("target").alias("w")).collect():
        taken[r["source"]] = r["t"] / r["w"]
    assert all(abs(v - 1) < 0.02 for v in taken.values())
    small, mixing.SMALL_TABLE = mixing.SMALL_TABLE, 0
    try:
        assert sorted(map(tuple, mixing.mix_plan(odd).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    finally:
        mixing.SMALL_TABLE = small


def test_toxicity(spark, odd, none):
    bad = table(spark, [(k, f"you are a {'fool' if k % 2 else 'friend'} of mine number {'abcdefghij'[k % 10]} indeed my dear", "a") for k in range(10, 130)])
    labels = bad.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    got = {r["doc_id"]: r for r in toxic.held_out_scores(bad.unionByName(odd), labels).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] and r["doc_id"] >= 10]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["predicted"] == got[2]["predicted"] == 0
    assert toxic.held_out_scores(none, labels).count() == 0
    assert {r["score"] for r in toxic.held_out_scores(odd, labels.where("toxic = 0")).collect()} == {0.0}
